"""The journal as a table of lines: JSON objects of three kinds, some of them damaged.

Lines keep the order of their file in ``ord``; blank, torn and non-object lines go to a
table of their own with a reason instead of failing a job.  A line's raw values stay in a
VARIANT, which tells an absent field from a null one and the number 1 from the text "1".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ord, line``: ordered within each file, files in the order of their reading."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``ord, line, row, reason``: the object of each line, or why there is none."""
    trimmed = F.trim(F.regexp_replace("line", r"^[\s﻿]+|\s+$", ""))
    v = lines.withColumn("row", F.try_parse_json(trimmed))
    kind = F.schema_of_variant("row")
    reason = F.when(trimmed == "", "blank").when(F.col("row").isNull(), "torn").when(~kind.startswith("OBJECT"), "not an object")
    return v.withColumn("reason", reason)


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").select("ord", "line", "row")


def bad_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NOT NULL AND reason <> 'blank'").select("ord", "line", "reason")


def field(row: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(row, f"$.{name}", kind)


def kind_of(row: Column) -> Column:
    """offer (no kind), mark, rule, or the unknown kind's own name."""
    return F.coalesce(field(row, "kind", "string"), F.lit("offer"))


def raw(row: Column, name: str) -> Column:
    """A field's JSON token in one spelling; null for an absent or null field.

    All numbers are doubles, so 34, 34.0 and 3.4e1 are one; texts keep their quotes.
    """
    v = F.try_variant_get(row, f"$.{name}", "variant")
    number = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    return F.when(v.isNull() | F.is_variant_null(v), None).when(number, field(row, name, "double").cast("string")).otherwise(F.to_json(v))


def sync_key(row: Column) -> Column:
    """The text by which a row is known wherever it is copied; null for a malformed row.

    Parts are JSON arrays of raw tokens, so that no value can imitate a separator.
    """
    def key(*parts: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(p, F.lit("null")) for p in parts)), F.lit("]"))

    name = field(row, "kind", "string")
    ident, seq = raw(row, "id"), raw(row, "seq")
    empty = lambda x: x.isNull() | (x == '""')
    said = [raw(row, "accepted"), raw(row, "hidden")]
    mark = F.when(~empty(ident), key(F.lit('"m"'), ident, raw(row, "at"), *said))
    rule = key(F.lit('"r"'), raw(row, "at"), *(raw(row, f"match.{x}") for x in ("pay", "minutes", "miles")), *said)
    tag = F.when(name.isNull(), F.lit('"o"')).otherwise(F.to_json(F.concat(F.lit("k"), name).cast("variant")))
    other = F.when(~empty(ident) & ~empty(seq), key(tag, ident, seq))
    return F.when(name == "mark", mark).when(name == "rule", rule).otherwise(other)


def write_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; files appear whole or not at all."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Append a batch of rows as JSON lines, keys in order; a batch that is written again replaces itself.

    Files appear whole or not at all, so there are no torn lines to mend.
    """
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    rows.select(line.alias("value")).write.mode("overwrite").text(f"{path}/batch={batch}")
