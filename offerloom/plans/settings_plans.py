"""Queries of stored settings, clocks, restarts, and the journal's last rows and appends."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import rating
from offerloom.plans.base import query
from offerloom.plans.control_plans import events
from offerloom.plans.stream_plans import _folder
from offerloom.sources import fixtures as fx
from offerloom.sources import journal_lines as jl
from offerloom.sources import settings

_SETTING = "CASE event_id % 8 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '\"' || event_id || '.5\"' WHEN 2 THEN 'true' WHEN 3 THEN '\"12 dollars\"' WHEN 4 THEN 'null' WHEN 5 THEN '0' WHEN 6 THEN '[' || event_id || ']' ELSE '\" ' || event_id || ' \"' END"


@query("SELECT event_id AS ord, CASE event_id % 8 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN event_id + 0.5::DOUBLE WHEN 5 THEN 0 WHEN 7 THEN event_id ELSE 25 END AS value FROM events")
def setting_values(spark, sf_dir):
    e = events(spark, sf_dir, f"SELECT event_id AS ord, {_SETTING.replace('event_id::VARCHAR', 'CAST(event_id AS STRING)')} AS said FROM {{events}}")
    return e.select("ord", rating.setting(F.try_parse_json("said"), F.lit(25.0)).alias("value"))


@query("SELECT event_id AS ord, CASE WHEN t >= TIMESTAMP '2025-01-01' THEN hour(t) * 60 + minute(t) END AS minutes FROM (SELECT event_id, ts + to_days(((event_id % 3) * 200)::INTEGER) AS t FROM events)")
def trusted_clock(spark, sf_dir):
    """A clock that hasn't been set yet tells no time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 3) * 200 * 86_400_000_000)
    return e.select(F.col("event_id").alias("ord"), rating.clock_minutes(at).cast("long").alias("minutes"))


@query(f"SELECT rig, ord, seen_ms - lag(seen_ms) OVER (PARTITION BY rig ORDER BY seen_ms, ord) AS gap_ms FROM {fx.offers_sql()}")
def frame_gaps(spark, sf_dir):
    return settings.gaps(fx.offers(spark, sf_dir), ["rig"]).select("rig", "ord", "gap_ms")


_STORED = (
    "SELECT event_id AS ord, CASE event_id % 5 WHEN 0 THEN '{\"target\":' || event_id % 60 || ',\"speak\":true}' WHEN 1 THEN '{\"target\":\"' || event_id % 60 || '\",\"name\":\"r' || event_id || '\"}' WHEN 2 THEN '{\"target\"'"
    " WHEN 3 THEN '[1]' ELSE '{\"target\":null,\"speak\":1,\"name\":\"' || event_id % 7 || '\",\"more\":2}' END AS stored FROM {events}"
)


@query("""SELECT event_id AS ord, CASE WHEN event_id % 5 = 0 THEN event_id % 60 ELSE 25 END::DOUBLE AS target, event_id % 5 = 0 AS speak, CASE event_id % 5 WHEN 1 THEN 'r' || event_id WHEN 4 THEN (event_id % 7)::VARCHAR ELSE 'rig' END AS name FROM events""")
def stored_settings(spark, sf_dir):
    e = events(spark, sf_dir, _STORED)
    return e.select("ord", settings.typed_settings(F.col("stored"), {"target": 25.0, "speak": False, "name": "rig"}).alias("s")).select("ord", "s.*")


_DRAFTS = (
    "SELECT event_id AS ord, CASE event_id % 6 WHEN 0 THEN 'torn{' WHEN 1 THEN '{\"t\":1000}' ELSE '{\"t\":' || (event_id * 61) % 400000 || ',\"active\":\"' || CASE WHEN event_id % 2 = 0 THEN 'pay' ELSE 'fuel' END"
    " || '\",\"entry\":{\"pay\":\"' || event_id % 90 || '\",\"minutes\":' || CASE WHEN event_id % 4 = 3 THEN '7' ELSE '\"7\"' END || '}}' END AS draft FROM {events}"
)


@query("""SELECT event_id AS ord, (event_id % 90)::VARCHAR AS pay, CASE WHEN event_id % 4 <> 3 THEN '7' END AS minutes, CASE WHEN event_id % 2 = 0 THEN 'pay' END AS active
  FROM events WHERE event_id % 6 > 1 AND 400000 - (event_id * 61) % 400000 <= 180000""")
def fresh_drafts(spark, sf_dir):
    """Drafts of the last three minutes."""
    return settings.fresh_drafts(events(spark, sf_dir, _DRAFTS), F.lit(400_000), ("pay", "minutes")).select("ord", "entry.*", "active")


@query(f"""SELECT rig, ord, least(60000, 3000 * pow(2, least(nth, 4)))::BIGINT AS wait_ms FROM (SELECT *, row_number() OVER (PARTITION BY rig, life ORDER BY seen_ms, ord) - 1 AS nth
  FROM (SELECT *, sum(CASE WHEN (ord * 7919) % 100000 > 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY rig ORDER BY seen_ms, ord) AS life FROM {fx.offers_sql()}))""")
def restart_waits(spark, sf_dir):
    runs = fx.offers(spark, sf_dir).withColumn("ran_ms", (F.col("ord") * 7919) % 100_000)
    return settings.restart_waits(runs, ["rig"]).select("rig", "ord", "wait_ms")


@query(f"SELECT rig, ord FROM (SELECT rig, ord, row_number() OVER (PARTITION BY rig ORDER BY ord DESC) AS nth FROM {fx.offers_sql()}) WHERE nth <= 25")
def journal_last_rows(spark, sf_dir):
    """The last 25 rows of each rig."""
    return settings.tail(fx.offers(spark, sf_dir), ["rig"], 25).select("rig", "ord")


@query(f"SELECT ord, rig, pay, miles, ord % 2 AS batch FROM {fx.offers_sql()}")
def journal_append(spark, sf_dir):
    """Rows appended in two batches, the first one written twice, and read again."""
    path, rows = f"{_folder(spark)}/journal", fx.offers(spark, sf_dir).select("rig", "ord", "pay", "miles")
    for batch in (0, 1, 0):
        jl.append_batch(rows.where(F.col("ord") % 2 == batch), path, batch)
    back = jl.parse_lines(spark.read.text(path).select(F.lit(0).cast("long").alias("ord"), F.col("value").alias("line"), "batch"))
    got = lambda name, kind: jl.field(F.col("row"), name, kind).alias(name)
    return back.where("reason IS NULL").select(got("ord", "long"), got("rig", "long"), got("pay", "double"), got("miles", "double"), F.col("batch").cast("long").alias("batch"))
