"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow with a weight.  Its documents come in a shuffled order (md5 of a seed
and doc_id), up to ``epochs`` times over, and each copy has a virtual finish time: the
source's tokens up to and with it, divided by the weight.  All copies are ordered by finish
time and taken until the total budget is spent.  A source that has no copies left drops
out and the others share on, so what a source gets comes within a document of its target:
the level V at which sum(min(epochs * size, weight * V)) equals the budget.

Running totals need no task that holds a whole source: a source's order is cut into
``SLICES`` by the leading hash digits, slices are summed first, and only inside a slice rows
are sorted.  Likewise the global order is cut into ranges of finish time, about as many as
the square root of the number of copies; the ranges' totals say where the budget ends, and
only that range's rows are sorted to find the last copy taken.

Null texts have size 0; rows of size 0 take no words.  A null source is a source of its own,
last in order.  Rows with the same doc_id, source and size are interchangeable, so reruns
agree.  An empty table gives an empty result.  Of a very long text only its words are counted;
it never moves before rows are taken.  The result's columns are the table's and the schedule's
own; a column of the table that has a schedule's name stays as the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.common import WORD, materialise

SEED = "mix"
#: Hex digits of the hash that name a slice.
SLICE_DIGITS = 3
SLICES = 16**SLICE_DIGITS
#: Weights of the sources by rank, repeating.
WEIGHTS = (3, 1, 2)
EPOCHS = 2
SHARE = 1.5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From ``source, source_size`` (one row a source): ``rank, weight, budget, target`` as well.

    Sources are few rows next to documents; the windows below see one row for each.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    every = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    ranked = ranked.withColumn("level", F.lit(epochs) * F.col("source_size") / F.col("weight"))
    full = W.orderBy("level", "rank").rowsBetween(W.unboundedPreceding, -1)
    left = W.orderBy("level", "rank").rowsBetween(0, W.unboundedFollowing)
    # the level if all sources before this one are full and it is the first that isn't
    at = (F.col("budget") - F.lit(epochs) * F.coalesce(F.sum("source_size").over(full), F.lit(0))) / F.sum("weight").over(left)
    ranked = ranked.withColumn("at", at)
    fits = F.when(F.col("at") <= F.col("level"), F.struct("level", "rank", "at"))
    ranked = ranked.withColumn("final", F.min(fits).over(every)["at"])
    cap = F.lit(float(epochs)) * F.col("source_size")
    return ranked.select("source", "source_size", "rank", "weight", "budget", F.coalesce(F.least(cap, F.col("weight") * F.col("final")), cap).alias("target"))


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def schedule(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``rows(doc_id, source, size)`` with ``source_size``, ``target``, ``finish`` (of the first
    copy), ``lap`` (added for each further copy) and ``copies`` taken."""
    rows = materialise(rows.select("doc_id", "source", "size", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h")))
    plan = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs))
    # running totals of each source
    rows = rows.withColumn("slice", F.conv(F.substring("h", 1, SLICE_DIGITS), 16, 10).cast("int"))
    sums = materialise(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    sums = materialise(sums.join(plan, F.col("s").eqNullSafe(F.col("source")), "left").drop("source"))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")), "left").drop("s", "k")
    inside = W.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    done = F.col("before") + F.sum("size").over(inside)
    timed = joined.withColumn("finish", done / F.col("weight")).withColumn("lap", F.col("source_size") / F.col("weight"))
    timed = materialise(timed.select("doc_id", "source", "size", "source_size", "target", "budget", "rank", "h", "finish", "lap"))
    # the global order, cut where the budget ends
    copies = timed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("time", F.col("finish") + F.col("copy") * F.col("lap"))
    total = timed.agg(F.count("*").alias("n"), F.max(F.col("finish") + (epochs - 1) * F.col("lap")).alias("end"), F.max("budget").alias("budget")).first()
    ranges = max(1, int((epochs * total["n"]) ** 0.5))
    width = (total["end"] or 0.0) / ranges or 1.0
    of = lambda time: F.floor(time / F.lit(width))
    spent = copies.groupBy(of(F.col("time")).alias("range")).agg(F.sum("size").alias("words"))
    spent = spent.withColumn("upto", F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)))
    last = spent.where(F.col("upto") > F.lit(float(total["budget"] or 0))).orderBy("range").limit(1).first()
    if last is None:
        return timed.withColumn("copies", F.lit(epochs))
    key = ["time", "rank", "h", "doc_id", "size", "copy"]
    inner = copies.where(of(F.col("time")) == last["range"]).withColumn("upto", F.lit(last["upto"] - last["words"]) + F.sum("size").over(W.orderBy(*key).rowsBetween(W.unboundedPreceding, 0)))
    cut = inner.where(F.col("upto") <= F.lit(float(total["budget"]))).orderBy(F.desc("upto"), *(F.desc(k) for k in key)).limit(1).select(*key).first()

    def taken(copy: int) -> Column:
        time = F.col("finish") + F.lit(copy) * F.col("lap")
        earlier = of(time) < last["range"]
        if cut is None:
            return earlier.cast("int")
        own = F.struct(time.alias("time"), "rank", "h", "doc_id", "size", F.lit(copy).alias("copy"))
        end = F.struct(*(F.lit(cut[k]).cast(dict(copies.dtypes)[k]).alias(k) for k in key))
        return (earlier | (of(time) == last["range"]) & (own <= end)).cast("int")

    return timed.withColumn("copies", sum((taken(c) for c in range(1, epochs)), taken(0)))


def mix_report(docs: DataFrame) -> DataFrame:
    plan = schedule(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows of ``docs`` in their global order: a document comes as often as it is
    taken, placed by its virtual finish time.  Rows that share doc_id and source and have the
    same size share one schedule entry each."""
    slim = docs.select(F.struct(*docs.columns).alias("doc"), F.struct("doc_id", "source", n_words(F.col("text")).alias("size")).alias("own"))
    plan = schedule(slim.select("own.*")).where("copies > 0")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"), F.min("finish").alias("finish"), F.min("lap").alias("lap"), F.min("rank").alias("rank"), F.min("h").alias("h"))
    plan = plan.select(F.struct("doc_id", "source", "size").alias("key"), "copies", "finish", "lap", "rank", "h")
    rows = slim.join(plan, F.col("own").eqNullSafe(F.col("key"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return rows.orderBy(F.col("finish") + F.col("copy") * F.col("lap"), "rank", "h", "copy").select("doc.*")


_WEIGHT_SQL = f"list_extract([{', '.join(map(str, WEIGHTS))}], (rank % {len(WEIGHTS)}) + 1)"
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, {_WEIGHT_SQL} AS weight, sum(source_size) OVER () * {SHARE}::DOUBLE AS budget FROM r),
l AS (SELECT *, ({EPOCHS} * source_size)::DOUBLE / weight AS lev FROM w),
a AS (SELECT *, (budget - {EPOCHS} * coalesce(sum(source_size) OVER (ORDER BY lev, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / (sum(weight) OVER (ORDER BY lev, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS at_level FROM l),
v AS (SELECT (SELECT at_level FROM a WHERE at_level <= lev ORDER BY lev, rank LIMIT 1) AS final_level),
p AS (SELECT source, source_size, rank, weight, budget, coalesce(least(({EPOCHS} * source_size)::DOUBLE, weight * final_level), ({EPOCHS} * source_size)::DOUBLE) AS target FROM a, v),
f AS (SELECT d.*, p.source_size, p.target, p.budget, p.rank, p.source_size::DOUBLE / p.weight AS lap,
        (sum(d.size) OVER (PARTITION BY p.rank ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::DOUBLE / p.weight AS finish
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT f.*, copy, finish + copy * lap AS t FROM f, (SELECT unnest(range({EPOCHS})) AS copy)),
k AS (SELECT *, sum(size) OVER (ORDER BY t, rank, h, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT doc_id, size, source_size, target, sum(CASE WHEN upto <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM k GROUP BY doc_id, size, source_size, target, h, rank, finish
"""
