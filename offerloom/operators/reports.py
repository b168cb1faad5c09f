"""Summaries of the record.  Percentiles interpolate linearly; days and hours are UTC."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.streaming.machines import Machine, Values, fold


def utc(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def quartiles(rows: DataFrame, by: list[str]) -> DataFrame:
    q = F.percentile("per_hour", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*by).agg(q.alias("q")).select(*by, *(F.get("q", i).alias(n) for i, n in enumerate(("p25", "p50", "p75"))))


def target_share(rows: DataFrame, by: list[str], target: Column) -> DataFrame:
    """Share of offers that clear the target."""
    return rows.groupBy(*by).agg(F.count("*").alias("offers"), (F.count_if(F.col("per_hour") >= target) / F.count("*")).alias("share"))


def three_hour_blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    block = F.floor(F.hour(utc(F.col("seen_ms"))) / 3).cast("long")
    return rows.groupBy(*by, block.alias("block")).agg(F.count("*").alias("offers"), F.median("per_hour").alias("median_per_hour"))


def shop_split(rows: DataFrame, by: list[str]) -> DataFrame:
    """Shopping jobs apart from the rest; offers that don't say stand on their own."""
    return rows.groupBy(*by, "shop").agg(F.count("*").alias("offers"), F.median("per_hour").alias("median_per_hour"))


def daily(rows: DataFrame, by: list[str]) -> DataFrame:
    day = F.date_format(utc(F.col("seen_ms")), "yyyy-MM-dd")
    return rows.groupBy(*by, day.alias("day")).agg(F.count("*").alias("offers"), F.median("per_hour").alias("median_per_hour"), F.sum(F.round(F.col("pay") * 100).cast("long")).alias("total_cents"))


def worked_and_offered(rows: DataFrame, by: list[str]) -> DataFrame:
    """What was offered and what of it was taken, for each day and (day null) in all."""
    day = F.date_format(utc(F.col("seen_ms")), "yyyy-MM-dd")
    cents = F.round(F.col("pay") * 100).cast("long")
    took = F.coalesce("accepted", F.lit(False))
    each = rows.withColumn("day", day).withColumn("cents", cents).withColumn("took", took)
    sets = [[*map(F.col, by), F.col("day")], [F.col(c) for c in by]]
    return each.groupingSets(sets, *by, "day").agg(F.count("*").alias("offered"), F.sum("cents").alias("offered_cents"), F.count_if("took").alias("worked"), F.coalesce(F.sum(F.when(F.col("took"), F.col("cents"))), F.lit(0)).alias("worked_cents"))


def history(rows: DataFrame, by: list[str], n: int = 100) -> DataFrame:
    """Mean and best $/h and the share of good verdicts of the newest ``n``, in per cent."""
    newest = W.partitionBy(*by).orderBy(F.desc("seen_ms"), F.desc("ord"))
    some = rows.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n)
    go = F.floor(100.0 * F.count_if(F.col("state") == "go") / F.count("*") + 0.5).cast("long")
    return some.groupBy(*by).agg(F.count("*").alias("rows"), F.max("per_hour").alias("best_per_hour"), F.avg("per_hour").alias("mean_per_hour"), go.alias("go_percent"))


def by_place(rows: DataFrame, query: str) -> DataFrame:
    """Offers one of whose places contains the words, in any case."""
    return rows.where(F.exists("places", lambda p: F.contains(F.lower(p), F.lit(query.lower()))))


HEALTH_S = 120


@dataclass
class Since:
    ms: int | None = None


class HealthClock(Machine):
    """A read to the time at which its window began: a rig's first read, or the first one two minutes after that of the window before."""

    STATES = {"since": Since}
    OUT = "rig long, from_ms long, ms long, complete boolean, no_pay boolean, failed boolean"

    def step(self, row: Values) -> Iterator[Values]:
        if self.since.ms is None or row["ts_ms"] - self.since.ms >= HEALTH_S * 1000:
            self.since.ms = row["ts_ms"]
        yield {**{c: row[c] for c in ("ms", "complete", "failed")}, "no_pay": row["pay"] is None, "from_ms": self.since.ms}


def health_reads(reads: DataFrame) -> DataFrame:
    """Reads in the form that ``HealthClock`` takes."""
    return reads.select("rig", F.lit(0).cast("long").alias("ord"), F.col("seen_ms").alias("ts_ms"), F.col("ms").cast("long").alias("ms"), "complete", "pay", "failed")


def told_health(rows: DataFrame) -> DataFrame:
    """Windows from reads that know theirs; a window holds two minutes of reads, so its latencies fit in a row."""
    ms = F.sort_array(F.collect_list("ms"))
    return rows.groupBy("rig", "from_ms").agg(
        F.count("*").alias("reads"), F.count_if("complete").alias("complete"), F.count_if("no_pay").alias("no_pay"), F.count_if("failed").alias("failed"),
        F.get(ms, F.floor(F.size(ms) / 2).cast("int")).alias("upper_median_ms"),
    )


def health(reads: DataFrame) -> DataFrame:
    """Reads in windows of two minutes or more: how many, how many whole, without pay, failed, and the upper median latency.

    A window begins with a rig's first read after the last window has ended, and ends with the
    first read that is two minutes later than its first; so windows without reads don't exist.
    A rig's reads stream through a task, which holds one time.
    """
    return told_health(fold(health_reads(reads), HealthClock))


def half_up(x: Column) -> Column:
    """To a whole number, halves up."""
    return F.floor(x + 0.5).cast("long")


def ago(ms: Column) -> Column:
    """How long ago, in words: minutes, hours and days each rounded from the one below."""
    minutes = half_up(ms / 60000)
    hours = half_up(minutes / 60)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, "now").when(minutes < 60, say(minutes, "m ago")).when(hours < 24, say(hours, "h ago")).otherwise(say(half_up(hours / 24), "d ago"))


def fixed(x: Column, decimals: int) -> Column:
    """So many decimals, halves of the shown digits away from zero."""
    return F.format_string(f"%.{decimals}f", x)


def money_text(x: Column, decimals: int = 2) -> Column:
    """An amount for display, its sign in front of the currency; two dashes if there is none."""
    known = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(known, F.concat(F.when(x < 0, "-$").otherwise("$"), fixed(F.abs(x), decimals))).otherwise("--")


def rate_text(x: Column) -> Column:
    """A rate for display: no decimals from 100 on, else one."""
    return F.when(F.abs(x) >= 100, money_text(x, 0)).otherwise(money_text(x, 1))


def round1(x: Column) -> Column:
    """To a tenth, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def spoken(state: Column, per_hour: Column, doubt: Column) -> Column:
    """What is said aloud: the verdict and the rate, or what to check; null without an offer."""
    words = F.when(state == "go", "accept").when(state == "warn", "close").when(state == "no", "pass")
    check = F.when(doubt == "pay", "check the pay.").when(doubt == "time", "check the time.").when(doubt == "speed", "check the distance.").otherwise("read that again.")
    rate = F.concat(words, F.lit(". "), F.bround(per_hour, 0).cast("long").cast("string"), F.lit(" an hour."))
    return F.when(state == "doubt", check).otherwise(rate)


def stage_medians(rows: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """The median time of each stage, one row for each."""
    return rows.unpivot(by, stages, "stage", "ms").groupBy(*by, "stage").agg(F.median("ms").alias("median_ms"))
