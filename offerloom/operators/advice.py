"""Advice from the record: runs, the replay of targets, and whether an answer is stable.

Each rig's offers are cut into runs by silences.  A replay of a target within a run is
greedy (take what pays enough while free) and so a fold over the run's offers in order; it
is parallel over rigs, runs and thresholds, which are one more key, not a loop.  All targets
are tried at once while a run's offers pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions.rating import finite
from offerloom.streaming.machines import dealt

# Thresholds in minutes, targets in dollars an hour, and the gates.
THRESHOLDS = (15, 20, 30, 45, 60, 90)
MAIN_THRESHOLD = 30
TARGETS = (0, 60)
PLATEAU = 0.95
LEAST_ROWS, LEAST_HOURS, LEAST_TRIPS, MOST_SPREAD = 40, 2, 6, 6


def flag(c: Column) -> Column:
    """A flag that may be missing."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def trustworthy(df: DataFrame) -> DataFrame:
    """Neither hidden nor suspect, and not known to be partial."""
    return df.where(~flag(F.col("hidden")) & ~flag(F.col("suspect")) & ~F.col("whole").cast("boolean").eqNullSafe(False))


def usable(df: DataFrame) -> DataFrame:
    """``rig, ord, seen_ms, net, mins, per_hour, took`` of offers with a finite pay and time.

    ``billed_minutes`` is used where it is given and ``cost`` where it is finite.
    """
    have = set(df.columns)
    billed = finite(F.col("billed_minutes")) if "billed_minutes" in have else F.lit(None).cast("double")
    cost = F.coalesce(finite(F.col("cost")), F.lit(0.0)) if "cost" in have else F.lit(0.0)
    at = F.coalesce("first_ms", "seen_ms") if "first_ms" in have else F.col("seen_ms")
    mins = F.coalesce(billed, finite(F.col("minutes")))
    rows = df.select("rig", "ord", at.alias("seen_ms"), (finite(F.col("pay")) - cost).alias("net"), mins.alias("mins"), flag(F.col("accepted")).alias("took"))
    rows = rows.where("net IS NOT NULL AND mins > 0 AND seen_ms IS NOT NULL")
    return rows.withColumn("per_hour", F.col("net") / (F.col("mins") / 60))


def free_again(df: DataFrame) -> DataFrame:
    """``idle_ms``: from when the driver was free after the previous offer to this one."""
    order = W.partitionBy("rig").orderBy("seen_ms", "ord")
    free = F.when(F.col("took"), F.col("seen_ms") + F.col("mins") * 60000).otherwise(F.col("seen_ms").cast("double"))
    return df.withColumn("free_ms", free).withColumn("idle_ms", F.col("seen_ms") - F.lag("free_ms").over(order))


def runs_of(thresholds: tuple[int, ...]):
    """Offers in order of rig and time to the same with ``runs``: the number of its run at each threshold."""
    gaps = np.array(thresholds) * 60000.0

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = free = None
        run = np.zeros(len(gaps), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rig = batch.column("rig").fill_null(-(1 << 63)).to_numpy()
            at, mins, took = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seen_ms", "mins", "took"))
            until = np.where(took, at + mins * 60000, at.astype(float))
            before = np.concatenate([[np.nan if free is None else free], until[:-1]])
            first = np.concatenate([[now is None or rig[0] != now], rig[1:] != rig[:-1]])
            begins = ~first[:, None] & (at - before > gaps[:, None]).T
            # counted on from the batch before, and anew from each rig's first offer
            count = np.cumsum(begins, axis=0) + run
            starts = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
            count -= np.where((starts >= 0)[:, None], count[np.maximum(starts, 0)], 0)
            now, free, run = rig[-1], until[-1], count[-1]
            yield batch.append_column("runs", pa.FixedSizeListArray.from_arrays(pa.array(count.ravel()), len(gaps)).cast(pa.list_(pa.int64())))

    return told


_OFFER = "rig long, ord long, seen_ms long, net double, mins double, took boolean, per_hour double"


def numbered(df: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Each rig's offers in order, each once, with ``runs``.  They are sorted once, whatever the number of thresholds, and stream through a task."""
    rows = df.select(*(F.col(n).cast(kind).alias(n) for n, kind in (x.split(" ") for x in _OFFER.split(", "))))
    return dealt(rows, "rig").sortWithinPartitions("rig", "seen_ms", "ord").mapInArrow(runs_of(thresholds), f"{_OFFER}, runs array<long>")


def segment(df: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Every offer once for each threshold, with its ``run`` there; ``runs`` and ``replay`` drop runs of one offer or no length."""
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, thresholds)).alias("threshold"), F.col("runs").alias("run")))
    return numbered(df, thresholds).withColumn("_at", each).select("rig", "ord", "seen_ms", "net", "mins", "took", "per_hour", "_at.threshold", "_at.run")


def runs(segments: DataFrame) -> DataFrame:
    told = segments.groupBy("rig", "threshold", "run").agg(F.count("*").alias("offers"), F.min("seen_ms").alias("first_ms"), F.max("seen_ms").alias("last_ms"))
    return told.where("offers > 1 AND last_ms > first_ms")


_TOTALS = "rig long, threshold int, target int, earned_cents long, busy_ms long, trips long, seen long"


def _replayed(targets: tuple[int, int]):
    """Offers in order of rig, threshold, run and time to totals for each target, added up over the runs that follow each other."""
    from_, to = targets
    wanted = np.arange(from_, to + 1, dtype=float)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rig", "threshold", "run", "seen_ms", "net", "mins", "per_hour"]
        now = total = None
        seen = rows = 0

        def ended() -> np.ndarray:
            """A run's earnings, time and trips; cents and milliseconds add up without rounding, whatever the order."""
            span = np.maximum(last, busy_until) - first
            return np.stack([np.rint(earned * 100), np.rint(span), trips])

        def counts() -> bool:
            return rows > 1 and last > first

        def told() -> Iterator[pa.RecordBatch]:
            if not seen:
                return
            n = len(wanted)
            whole = [x.astype(np.int64) for x in total]
            columns = [np.full(n, now[0], np.int64), np.full(n, now[1], np.int32), wanted.astype(np.int32), *whole, np.full(n, seen, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rig", "threshold", "target", "earned_cents", "busy_ms", "trips", "seen"])

        for batch in batches:
            for rig, threshold, run, at, net, mins, per_hour in zip(*(batch.column(c).to_pylist() for c in names)):
                if now != (rig, threshold, run):
                    if now is not None:
                        if counts():
                            total, seen = total + ended(), seen + rows
                        if now[:2] != (rig, threshold):
                            yield from told()
                    if now is None or now[:2] != (rig, threshold):
                        total, seen = np.zeros((3, len(wanted))), 0
                    now, first, rows = (rig, threshold, run), at, 0
                    earned, trips, busy_until = np.zeros(len(wanted)), np.zeros(len(wanted)), np.full(len(wanted), -1.0)
                last = at
                rows += 1
                if per_hour < from_:
                    continue
                takes = np.flatnonzero((busy_until <= at) & (wanted <= per_hour))
                if len(takes):
                    earned[takes] += net
                    trips[takes] += 1
                    busy_until[takes] = at + mins * 60000.0
        if now is not None:
            if counts():
                total, seen = total + ended(), seen + rows
            yield from told()

    return replayed


def replay(segments: DataFrame, targets: tuple[int, int] = TARGETS) -> DataFrame:
    """``rig, threshold, target``: earned, hours, trips and offers over all runs.

    Runs are dealt by their key and sorted, and their offers stream through a task that holds one state for each
    target; so a run may be of any length.  A task adds up the runs it has of a rig and threshold.
    """
    key = ["rig", "threshold", "run"]
    rows = segments.select(F.col("rig").cast("long").alias("rig"), F.col("threshold").cast("int").alias("threshold"), "run", "seen_ms", "ord", "net", "mins", "per_hour")
    parts = dealt(rows, *key).sortWithinPartitions(*key, "seen_ms", "ord").mapInArrow(_replayed(targets), _TOTALS)
    total = parts.groupBy("rig", "threshold", "target").agg(*(F.sum(c).alias(c) for c in ("earned_cents", "busy_ms", "trips", "seen")))
    per_hour = F.coalesce(F.try_divide(F.col("earned_cents") / 100.0, F.col("busy_ms") / 3600000.0), F.lit(0.0))
    return total.withColumn("per_hour", per_hour).withColumn("hours", F.col("busy_ms") / 3600000.0).withColumn("takes", F.coalesce(F.try_divide(F.col("trips"), F.col("seen")), F.lit(0.0)))


def answers(steps: DataFrame) -> DataFrame:
    """One row for each rig and threshold: the best target and the range around it that earns nearly as much.

    ``best`` earned most an hour, the lowest among equals, with at least one trip; ``low`` and
    ``high`` bound the unbroken range of targets with trips that reach ``PLATEAU`` of it.
    ``ladder`` keeps all targets in order.
    """
    names = ("target", "per_hour", "trips", "hours", "seen")
    rows = steps.groupBy("rig", "threshold").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("ladder"))
    tried = F.filter("ladder", lambda x: x["trips"] >= 1)
    top = F.array_max(F.transform(tried, lambda x: F.struct(x["per_hour"].alias("per_hour"), (-x["target"]).alias("less"), *(x[n].alias(n) for n in ("trips", "hours", "seen")))))
    rows = rows.withColumn("top", top).where("top.per_hour > 0")
    rows = rows.select("rig", "threshold", "ladder", (-F.col("top.less")).alias("best"), F.col("top.per_hour").alias("best_per_hour"), "top.trips", "top.hours", "top.seen")
    # the range ends before the nearest target on either side that falls short
    short = F.transform(F.filter("ladder", lambda x: (x["trips"] < 1) | (x["per_hour"] < F.col("best_per_hour") * PLATEAU)), lambda x: x["target"])
    below = F.array_max(F.filter(short, lambda t: t < F.col("best"))) + 1
    above = F.array_min(F.filter(short, lambda t: t > F.col("best"))) - 1
    ends = [F.get("ladder", 0)["target"], F.element_at("ladder", -1)["target"]]
    return rows.withColumn("low", F.coalesce(below, ends[0])).withColumn("high", F.coalesce(above, ends[1]))


def spreads(found: DataFrame) -> DataFrame:
    """How far thresholds disagree about the range."""
    return found.groupBy("rig").agg(F.count("*").alias("thresholds"), (F.max("low") - F.min("low")).alias("spread_low"), (F.max("high") - F.min("high")).alias("spread_high"))


def coverage(df: DataFrame, threshold: int = MAIN_THRESHOLD) -> DataFrame:
    """What an answer rests on: offers in runs and runs, the offers set aside, and from when to when."""
    inside = runs(segment(df, (threshold,))).groupBy("rig").agg(F.sum("offers").alias("offers"), F.count("*").alias("runs"))
    every = df.groupBy("rig").agg(F.count("*").alias("rows"), F.min("seen_ms").alias("from_ms"), F.max("seen_ms").alias("to_ms"))
    n = F.coalesce("offers", F.lit(0))
    return every.join(inside, "rig", "left").select("rig", n.alias("offers"), F.coalesce("runs", F.lit(0)).alias("runs"), (F.col("rows") - n).alias("set_aside"), "from_ms", "to_ms")


def unexplained(df: DataFrame, threshold: int = MAIN_THRESHOLD) -> DataFrame:
    """Silences longer than the threshold, and how many offers are marked as taken."""
    return free_again(df).groupBy("rig").agg(F.count_if(F.col("idle_ms") > threshold * 60000.0).alias("silences"), F.count_if("took").alias("tagged"))


def advise(offers: DataFrame, target: int = 25) -> DataFrame:
    """One row for each rig: ``ready`` with a suggested target, or the reason for none.

    Gates come in order: too little recorded (``trips``), no target helps (``nolinehelps``),
    thresholds disagree (``unsettled``).  What a target would have earned is not given out.
    """
    counted = usable(trustworthy(offers))
    found = answers(replay(segment(counted)))
    main = F.when(F.col("threshold") == MAIN_THRESHOLD, F.struct("best", "low", "high", "trips", "hours", "ladder"))
    # a rig's few answers meet in one row
    found = found.groupBy("rig").agg(
        F.count("*").alias("thresholds"), (F.max("low") - F.min("low")).alias("spread_low"), (F.max("high") - F.min("high")).alias("spread_high"),
        F.first(main, ignorenulls=True).alias("main"),
    ).select("rig", "thresholds", "spread_low", "spread_high", "main.*")
    every = offers.groupBy("rig").agg(F.count("*").alias("recorded"))
    out = every.join(counted.groupBy("rig").agg(F.count("*").alias("rows")), "rig", "left").join(found, "rig", "left")
    at = lambda t: F.get(F.filter("ladder", lambda x: x["target"] == t), 0)
    now, then = at(F.lit(target)), at(F.col("low"))
    n = F.coalesce("rows", F.lit(0))
    short = (n < LEAST_ROWS) | F.col("best").isNull() | (F.col("hours") < LEAST_HOURS) | (F.col("trips") < LEAST_TRIPS)
    restless = (F.col("spread_low") > MOST_SPREAD) | (F.col("spread_high") > MOST_SPREAD) | (F.col("thresholds") < 2)
    reason = F.when(short, "trips").when(F.col("low") <= TARGETS[0], "nolinehelps").when(restless, "unsettled")
    out = out.withColumn("reason", reason).withColumn("ready", F.col("reason").isNull())
    gain = F.when(now["per_hour"] > 0, (then["per_hour"] - now["per_hour"]) / now["per_hour"])
    if_ready = lambda c: F.when(F.col("ready"), c)
    return out.select("rig", n.alias("rows"), "ready", "reason", if_ready(F.col("low")).alias("suggested"), if_ready(F.col("high")).alias("plateau_high"), if_ready(F.round(gain, 4)).alias("gain"), if_ready(F.coalesce(now["trips"] == 0, F.lit(True))).alias("takes_nothing"))
