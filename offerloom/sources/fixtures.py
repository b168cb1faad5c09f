"""Offers, readings, cards and words derived from the driver tables.

Only integer arithmetic is used, so that Spark and DuckDB agree bit for bit.  Each fixture
comes as a DataFrame and as the text of the same common table expression for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: pay and minutes of the variants, in a dialect both engines share.
_VARIANTS = {
    "uniform": ("(200 + (event_id * 7919) % 2800) / 100.0{d}", "CAST(5 + (event_id * 31) % 40 AS DOUBLE)", "(5 + (event_id * 17) % 150) / 10.0{d}"),
    "two_tier": ("CAST(CASE WHEN event_id % 3 = 0 THEN 18 ELSE 5 END AS DOUBLE)", "CAST(30 AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    "flat": ("CAST(10 AS DOUBLE)", "CAST(20 AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    # few offers a rig: each rig has thirty
    "thin": ("CAST(CASE WHEN event_id % 3 = 0 THEN 18 ELSE 5 END AS DOUBLE)", "CAST(30 AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
}
RIGS = 4


def _select(variant: str, d: str, seen: str) -> str:
    pay, minutes, miles = (x.format(d=d) for x in _VARIANTS[variant])
    return (
        f"SELECT {'event_id // 30' if variant == 'thin' else f'user_id % {RIGS}'} AS rig, event_id AS ord, {seen} AS seen_ms, CAST({pay} AS DOUBLE) AS pay, {minutes} AS minutes,"
        f" CAST({miles} AS DOUBLE) AS miles, event_type = 'purchase' AS accepted, event_id % 97 = 0 AS hidden, event_id % 53 = 0 AS suspect,"
        f" CASE WHEN event_id % 41 = 0 THEN false END AS whole, CASE WHEN event_id % 5 = 0 THEN true END AS shop FROM events"
    )


def offers(spark: SparkSession, sf_dir: str, variant: str = "uniform") -> DataFrame:
    """One offer for each event: rig, ord, seen_ms, pay, minutes, miles, accepted, hidden, suspect, whole, shop."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen = "unix_micros(CAST(ts AS TIMESTAMP)) div 1000"
    return spark.sql(_select(variant, "D", seen).replace(" // ", " div ").replace("FROM events", "FROM {events}"), events=events)


def offers_sql(variant: str = "uniform") -> str:
    return f"({_select(variant, '::DOUBLE', 'epoch_us(ts) // 1000')})"


#: Three readings of each offer, one of them damaged now and then.
_READINGS = (
    "SELECT rig, offer DIV 3 AS id, CAST(offer % 3 + 1 AS INT) AS seq, ord, seen_ms, pay0 * CASE WHEN (offer DIV 3) % 7 = 0 AND offer % 3 = 1 THEN 100 ELSE 1 END AS pay,"
    " minutes0 AS minutes, CASE WHEN (offer DIV 3) % 5 = 0 AND offer % 3 = 2 THEN NULL ELSE miles0 END AS miles,"
    " CASE WHEN (offer DIV 3) % 11 = 0 AND offer % 3 = 0 THEN false END AS whole,"
    " pay0 * CASE WHEN (offer DIV 3) % 7 = 0 AND offer % 3 = 1 THEN 100 ELSE 1 END > 300 AS suspect, accepted, hidden"
    " FROM (SELECT o.*, ord AS offer, (200 + ((ord DIV 3) * 7919) % 2800) / 100.0{d} AS pay0, CAST(5 + ((ord DIV 3) * 31) % 40 AS DOUBLE) AS minutes0,"
    " (5 + ((ord DIV 3) * 17) % 150) / 10.0{d} AS miles0 FROM {o} o) x"
)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_READINGS.replace("{d}", "D"), o=offers(spark, sf_dir))


def readings_sql() -> str:
    return f"({_READINGS.replace('{d}', '::DOUBLE').replace(' DIV ', ' // ').replace('{o}', offers_sql())})"


_MARKS = (
    "SELECT user_id % 4 AS rig, event_id DIV 3 AS id, event_id AS ord, CASE WHEN event_type = 'purchase' THEN true WHEN event_id % 2 = 0 THEN false END AS accepted,"
    " CASE WHEN event_type = 'error' THEN event_id % 4 <> 0 END AS hidden FROM {events} WHERE event_type IN ('purchase', 'error')"
)
_RULES = (
    "SELECT user_id % 4 AS rig, event_id AS ord, (200 + ((event_id DIV 3) * 7919) % 2800) / 100.0{d} AS pay, CAST(5 + ((event_id DIV 3) * 31) % 40 AS DOUBLE) AS minutes,"
    " CASE WHEN event_id % 2 = 0 THEN (5 + ((event_id DIV 3) * 17) % 150) / 10.0{d} END AS miles, event_id % 5 <> 0 AS hidden FROM {events} WHERE event_type = 'click'"
)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MARKS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RULES.replace("{d}", "D"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def marks_sql() -> str:
    return f"({_MARKS.replace(' DIV ', ' // ').replace('{events}', 'events')})"


def rules_sql() -> str:
    return f"({_RULES.replace('{d}', '::DOUBLE').replace(' DIV ', ' // ').replace('{events}', 'events')})"


#: The numbers behind a card.
_CARD_NUMBERS = (
    "SELECT o_orderkey AS ord, 200 + (o_orderkey * 7919) % 2800 AS cents, 2 + (o_orderkey * 13) % 28 AS m1, 3 + (o_orderkey * 29) % 30 AS m2,"
    " 1 + (o_orderkey * 17) % 9 AS d1, 2 + (o_orderkey * 23) % 11 AS d2, 1 + o_orderkey % 9 AS items, 1 + o_orderkey % 12 AS hr, o_orderkey % 60 AS mi,"
    " o_orderkey % 4 AS kind FROM {orders}"
)


def card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CARD_NUMBERS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def card_numbers_sql() -> str:
    return f"({_CARD_NUMBERS.replace('{orders}', 'orders')})"


def cards(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Card texts: two-leg rides, totals, deliveries and shopping jobs; every fifth misread.

    ``dealt``: over as many parts as a shuffle has, whatever the scan's.
    """
    c = card_numbers(spark, sf_dir)
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ord") if dealt else c
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    money = F.concat(F.lit("$"), (F.col("cents") / 100).cast("long"), F.lit("."), two(F.col("cents") % 100))
    leg = lambda m, d, after: F.concat(F.col(m), F.lit(" min ("), F.col(d), F.lit(".5 mi) "), F.lit(after))
    ride = F.concat_ws(" ", F.lit("UberX"), money, leg("m1", "d1", "away"), leg("m2", "d2", "trip"))
    total = F.concat_ws(" ", money, F.lit("Guaranteed"), F.concat(F.col("items"), F.lit(" items")), leg("m2", "d2", "total"))
    late = F.concat(F.lit("Deliver by "), F.col("hr"), F.lit(":"), two(F.col("mi")), F.lit(" PM"))
    drop = F.concat_ws(" ", F.lit("Decline"), money, F.lit("Guaranteed"), F.concat(F.col("d2"), F.lit(".5 mi")), late, F.lit("Pickup Corner Bakery Customer dropoff Accept"))
    shop = F.concat_ws(" ", F.lit("Shop & Deliver"), money, leg("m1", "d1", "total"))
    text = F.when(F.col("kind") == 0, ride).when(F.col("kind") == 1, total).when(F.col("kind") == 2, drop).otherwise(shop)
    # digits read as letters, in front of a unit or after a dollar sign only
    damaged = F.regexp_replace(text, r"(?<=\$\d{0,3})0(?=\d*\.)|(?<=\.)0", "O")
    return c.withColumn("text", F.when(F.col("ord") % 5 == 0, damaged).otherwise(text))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words from ``lineitem``: orders are pages, quantities heights."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 2).alias("block"), (F.col("l_linenumber") % 2).alias("par"), (F.col("l_partkey") % 2).alias("line"),
        F.col("l_linenumber").alias("nth"), (F.col("l_partkey") % 500).alias("left"), (F.col("l_suppkey") % 300).alias("top"), F.lit(40).alias("width"), F.col("l_quantity").cast("long").alias("height"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("$"), (F.col("l_quantity").cast("long") + 1).cast("string"), F.lit(".50"))).otherwise(F.concat(F.lit("w"), F.col("l_partkey").cast("string"))).alias("text"),
    )


WORDS_SQL = (
    "(SELECT l_orderkey AS page, l_suppkey % 2 AS block, l_linenumber % 2 AS par, l_partkey % 2 AS line, l_linenumber AS nth, l_partkey % 500 AS \"left\","
    " l_suppkey % 300 AS top, 40 AS width, l_quantity::BIGINT AS height, CASE WHEN l_linenumber % 3 = 0 THEN '$' || (l_quantity::BIGINT + 1) || '.50'"
    " ELSE 'w' || l_partkey END AS text FROM lineitem)"
)
