"""Stored settings and drafts, read tolerantly: what can't be read is as if it were absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.sources.journal_lines import field

#: How long a draft is kept; the wait before a restart, its longest, and a run that counts as healthy.
DRAFT_MS = 180_000
RESTART_MS, MOST_RESTART_MS, DOUBLINGS, HEALTHY_MS = 3_000, 60_000, 4, 60_000

Default = bool | float | str


def object_of(text: Column) -> Column:
    """A text's object as a VARIANT; an empty object if it is none, or can't be read."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.parse_json(F.lit("{}")))


def typed_settings(text: Column, defaults: dict[str, Default]) -> Column:
    """A struct of the stored settings, each of its default's type, or else the default."""
    held = object_of(text)

    def value(name: str, default: Default) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(held, f"$.{name}", "variant"))
        wanted, sql = {bool: ("^BOOLEAN", "boolean"), str: ("^STRING", "string")}.get(type(default), ("^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "double"))
        return F.coalesce(F.when(kind.rlike(wanted), field(held, name, sql)), F.lit(default).cast(sql)).alias(name)

    return F.struct(*(value(n, d) for n, d in defaults.items()))


def fresh_drafts(rows: DataFrame, now_ms: Column, fields: tuple[str, ...], text: str = "draft") -> DataFrame:
    """``entry, active`` of the drafts that aren't older than three minutes: the fields that hold text, and a field that exists."""
    held = object_of(F.col(text))
    entry, at = F.try_variant_get(held, "$.entry", "variant"), field(held, "t", "double")
    whole = F.coalesce(F.schema_of_variant(entry).startswith("OBJECT"), F.lit(False)) & F.coalesce(now_ms - at <= DRAFT_MS, F.lit(False))
    said = F.struct(*(F.when(F.schema_of_variant(F.try_variant_get(entry, f"$.{f}", "variant")) == "STRING", field(entry, f, "string")).alias(f) for f in fields))
    active = field(held, "active", "string")
    return rows.where(whole).withColumns({"entry": said, "active": F.when(active.isin(*fields), active)})


def restart_waits(rows: DataFrame, by: list[str]) -> DataFrame:
    """``wait_ms`` before the next start after each exit (``ran_ms``): doubling with exits in a row, anew after a healthy run."""
    order = W.partitionBy(*by).orderBy("seen_ms", "ord")
    rows = rows.withColumn("_life", F.sum((F.col("ran_ms") > HEALTHY_MS).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy(*by, "_life").orderBy("seen_ms", "ord")) - 1
    return rows.withColumn("wait_ms", F.least(F.lit(MOST_RESTART_MS), RESTART_MS * F.pow(F.lit(2), F.least(nth, F.lit(DOUBLINGS)))).cast("long")).drop("_life")


def gaps(rows: DataFrame, by: list[str]) -> DataFrame:
    """``gap_ms`` since the row before; null for the first."""
    return rows.withColumn("gap_ms", F.col("seen_ms") - F.lag("seen_ms").over(W.partitionBy(*by).orderBy("seen_ms", "ord")))


def tail(rows: DataFrame, by: list[str], n: int, order: str = "ord") -> DataFrame:
    """The last ``n`` rows of each of ``by``; 0: all of them."""
    if n <= 0:
        return rows
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_nth") <= n).drop("_nth")
