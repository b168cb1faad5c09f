"""Streams into the journal: framing, routing, bounded bodies, first-wins copies, last values.

Every sink of a micro-batch is a folder named by the batch, replaced as a whole, so a batch
that is run again after a failure leaves what it would have left the first time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from offerloom.sources.journal_lines import field, parse_lines, sync_key
from offerloom.streaming.machines import Machine, Values

#: Fixed value: the longest body that is read, in bytes.
BODY_BYTES = 8 << 20
#: Keys of a micro-batch up to which they are broadcast to the stored ones; more are joined by shuffle.
FEW_KEYS = 1 << 20


@dataclass
class Tail:
    text: str = ""
    lines: int = 0


class Framing(Machine):
    """A producer's output in pieces (``chunk``) to its lines; what follows the last line break waits for the next piece.

    Lines are trimmed and blank ones go; a null piece holds nothing.
    """

    STATES = {"tail": Tail}
    OUT = "rig long, ord long, ts_ms long, line string"

    def step(self, row: Values) -> Iterator[Values]:
        *whole, rest = (self.tail.text + (row["chunk"] or "")).split("\n")
        self.tail.text = rest
        for line in filter(None, (x.strip() for x in whole)):
            yield {"ord": self.tail.lines, "ts_ms": row["ts_ms"], "line": line}
            self.tail.lines += 1


def routed(lines: DataFrame) -> DataFrame:
    """``lines(line, ...)`` with ``route``: journal for an object, log for all else; of objects ``phase`` and ``ready``."""
    parsed = parse_lines(lines.withColumn("ord", F.col("ord")))
    whole = F.col("reason").isNull()
    return parsed.withColumn("route", F.when(whole, "journal").otherwise("log")).withColumns({"phase": field(F.col("row"), "phase", "string"), "ready": field(F.col("row"), "ready", "boolean")})


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """One micro-batch's rows in a folder of its own, replaced if the batch is run again."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """What earlier batches wrote (all, or those before a batch); empty if none did."""
    try:
        rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch long")
    return rows if before is None else rows.where(F.col("batch") < before)


LINE = "rig long, ord long, ts_ms long, line string"


def route(lines: DataFrame, journal: str, log: str) -> DataStreamWriter:
    """One stream of lines to two sinks: objects to ``journal``, other lines to ``log``."""

    def put(rows: DataFrame, batch: int) -> None:
        told = routed(rows).select("rig", "ord", "ts_ms", "line", "route")
        told.persist()
        for name, path in (("journal", journal), ("log", log)):
            write_batch(told.where(F.col("route") == name).drop("route"), path, batch)
        told.unpersist()

    return lines.writeStream.foreachBatch(put)


FILES = "path string, modificationTime timestamp, length long, content binary"


def bodies(spark: SparkSession, path: str, cap: int = BODY_BYTES, bytes_per_batch: int = 64 << 20, clean: str = "delete") -> DataFrame:
    """A stream of request bodies, each a file: ``path, received, bytes, reason, body``.

    A batch reads so many bytes at most; a file over ``cap`` is refused with a reason, and its content isn't
    looked at; a file without content is no body; files are deleted (or archived) once a later batch has begun.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("maxBytesPerTrigger", bytes_per_batch).option("cleanSource", clean)
    return told_bodies(files.load(path), cap)


def told_bodies(files: DataFrame, cap: int = BODY_BYTES) -> DataFrame:
    fits = F.col("length") <= cap
    text = F.when(fits, F.try_validate_utf8(F.col("content").cast("string")))
    reason = F.when(~fits, F.format_string("body over %d bytes", F.lit(cap))).when(text.isNull(), "not text")
    return files.select("path", F.col("modificationTime").alias("received"), F.col("length").alias("bytes"), reason.alias("reason"), text.alias("body"))


def body_lines(told: DataFrame) -> DataFrame:
    """``path, nth, line`` of the bodies that were accepted."""
    rows = told.where("reason IS NULL").select("path", F.posexplode(F.split("body", "\n")).alias("nth", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where("line <> ''")


def with_key(lines: DataFrame) -> DataFrame:
    """Lines with the text by which a row is known wherever it is copied; null for what is malformed."""
    parsed = parse_lines(lines)
    return parsed.withColumn("sync_key", F.when(F.col("reason").isNull(), sync_key(F.col("row")))).drop("row", "reason")


KEYED = "ord long, line string, sync_key string"


def unseen(rows: DataFrame, seen: DataFrame, key: str = "sync_key", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The first row of each key that isn't among ``seen``; rows without a key go.

    The batch's keys, if they are few, are broadcast to the stored ones, so that these are scanned and not
    shuffled; then only the batch itself moves.
    """
    first = rows.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")
    keys = first.select(key)
    keys = F.broadcast(keys) if keys.count() <= FEW_KEYS else keys
    known = seen.select(key).join(keys, key, "left_semi").distinct()
    return first.join(known, key, "left_anti")


def ingest(lines: DataFrame, store: str, counts: str) -> DataStreamWriter:
    """Lines of a stream whose key isn't stored, the first of a key in every order of batches, to ``store``; what each
    batch added and what was malformed to ``counts``.  A batch that is run again sees only the batches before it."""

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        told = rows if "sync_key" in rows.columns else with_key(rows)
        told = told.select("ord", "line", "sync_key")
        told.persist()
        write_batch(unseen(told, stored(spark, store, KEYED, batch)), store, batch)
        added = spark.read.schema(KEYED).parquet(f"{store}/batch={batch}").count()
        told.agg(F.count("*").alias("rows"), F.count_if(F.col("sync_key").isNull()).alias("malformed"), F.lit(added).cast("long").alias("added")).write.mode("overwrite").parquet(f"{counts}/batch={batch}")
        told.unpersist()

    return lines.writeStream.foreachBatch(put)


def last_values(rows: DataFrame, store: str, by: str = "rig", order: tuple[str, ...] = ("seen_ms", "ord")) -> DataStreamWriter:
    """Each key's last row, kept in ``store`` for readers that come late: the newest batch folder holds all of them.

    A key's state is its last row alone; a batch tells the keys that it changed, and the folder after it is the
    folder before it with these replaced.
    """
    rest = [c for c in rows.columns if c != by]
    last = rows.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))

    def put(changed: DataFrame, batch: int) -> None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changed.schema.fields)
        held = stored(changed.sparkSession, store, schema, batch)
        newest = held.agg(F.max("batch")).first()[0]
        kept = held.where(F.col("batch") == newest).drop("batch") if newest is not None else held.drop("batch")
        write_batch(kept.join(changed.select(by), by, "left_anti").unionByName(changed), store, batch)

    return last.writeStream.outputMode("update").foreachBatch(put)


def newest_values(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """What a reader that comes late is told."""
    held = stored(spark, store, schema)
    newest = held.agg(F.max("batch")).first()[0]
    return held.where(F.col("batch") == (-1 if newest is None else newest)).select("*").drop("batch")


_MAP = "map<string,variant>"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is found once, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def merged_object(before: Column, update: Column, clear: tuple[str, ...] = (), defaults: Column | None = None) -> Column:
    """A JSON object with the keys of ``update`` replaced, those of ``clear`` gone, and ``defaults`` for keys it lacks.

    Keys stand in order; what isn't an object counts as an empty one.
    """
    keys = lambda text: F.coalesce(F.from_json(F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text), _MAP), F.from_json(F.lit("{}"), _MAP))
    # a function within another's is run for each element, so maps and their keys are named before they are used there
    without = lambda m, names: _let(names, lambda n: F.map_filter(m, lambda k, _: ~F.array_contains(n, k)))
    over = lambda m, more: _let(F.struct(m.alias("m"), more.alias("more")), lambda x: F.map_concat(without(x["m"], F.map_keys(x["more"])), x["more"]))
    done = over(keys(before), keys(update))
    if clear:
        done = without(done, F.array(*map(F.lit, clear)))
    if defaults is not None:
        done = over(keys(defaults), done)
    said = lambda e: F.struct(e["key"].alias("key"), F.concat(F.to_json(F.concat(e["key"], F.lit("")).cast("variant")), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))).alias("said"))
    pairs = F.array_sort(F.transform(F.map_entries(done), said))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["said"]), ","), F.lit("}"))


def backups(requests: DataFrame, kept: DataFrame, by: str = "rig") -> DataFrame:
    """``body, changed, error`` of each request (``ord``, ``body``): a calibration is kept if it differs from the one before.

    ``kept(by, digest)``: what is stored.  A request that isn't an object with a truthy ``quad`` is refused and changes nothing.
    """
    v = F.try_parse_json("body")
    quad = F.try_variant_get(v, "$.quad", "variant")
    plain = F.to_json(quad)
    whole = F.schema_of_variant(v).startswith("OBJECT") & quad.isNotNull() & ~F.coalesce(plain.isin("null", "false", "0", '""'), F.lit(True))
    told = requests.withColumn("error", F.when(~F.coalesce(whole, F.lit(False)), "not a calibration"))
    told = told.withColumn("digest", F.when(F.col("error").isNull(), F.sha2(F.to_json(v).cast("binary"), 256)))
    told = told.join(kept.select(by, F.col("digest").alias("_kept")), by, "left")
    before = F.coalesce(F.last("digest", ignorenulls=True).over(W.partitionBy(by).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.col("_kept"))
    return told.withColumn("changed", F.col("error").isNull() & ~F.col("digest").eqNullSafe(before)).drop("_kept")
