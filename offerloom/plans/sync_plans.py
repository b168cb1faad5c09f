"""Queries of replication and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import sync
from offerloom.plans.base import query
from offerloom.sources import fixtures as fx
from offerloom.sources import journal_lines as jl

NOW = 1_707_000_000_000
BATCH = f"(SELECT rig, ord, seen_ms, CASE WHEN ord % 19 = 0 THEN NULL ELSE (ord // 2)::VARCHAR END AS sync_key FROM {fx.offers_sql()})"
HAVE = f"(SELECT DISTINCT sync_key FROM {BATCH} WHERE ord % 5 = 0 AND sync_key IS NOT NULL)"
FAR = f"(SELECT * FROM {fx.offers_sql()} WHERE seen_ms < 1705500000000 AND (rig <> 2 OR ord % 7 <> 0) AND rig <> 3)"


def batch(spark, sf_dir):
    o = fx.offers(spark, sf_dir)
    return o.select("rig", "ord", "seen_ms", F.when(F.col("ord") % 19 != 0, F.floor(F.col("ord") / 2).cast("long").cast("string")).alias("sync_key"))


def have(spark, sf_dir):
    return batch(spark, sf_dir).where("ord % 5 = 0 AND sync_key IS NOT NULL")


def far(spark, sf_dir):
    return fx.offers(spark, sf_dir).where("seen_ms < 1705500000000 AND (rig <> 2 OR ord % 7 <> 0) AND rig <> 3")


FRESH = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sync_key ORDER BY ord) AS nth FROM {BATCH} WHERE sync_key IS NOT NULL AND sync_key NOT IN (SELECT sync_key FROM {HAVE})) WHERE nth = 1)"


@query(f"SELECT ord, sync_key FROM {FRESH}")
def ingest_anti_join(spark, sf_dir):
    return sync.fresh(batch(spark, sf_dir), have(spark, sf_dir)).select("ord", "sync_key")


@query(f"SELECT ord, sync_key FROM (SELECT *, row_number() OVER (PARTITION BY sync_key ORDER BY ord) AS nth FROM {BATCH} WHERE sync_key IS NOT NULL) WHERE nth = 1")
def ingest_distinct(spark, sf_dir):
    return sync.distinct_rows(batch(spark, sf_dir)).select("ord", "sync_key")


@query(f"SELECT (SELECT count(*) FROM {FRESH}) AS added, (SELECT count(*) FROM {BATCH} WHERE sync_key IS NOT NULL) - (SELECT count(*) FROM {FRESH}) AS duplicates, (SELECT count(*) FROM {BATCH} WHERE sync_key IS NULL) AS malformed")
def ingest_counts(spark, sf_dir):
    return sync.ingest_counts(batch(spark, sf_dir), have(spark, sf_dir))


@query(f"SELECT * EXCLUDE (nth) FROM (SELECT ord, sync_key, 'batch' AS came, 0 AS nth FROM {FRESH} UNION ALL SELECT min(ord), sync_key, 'copy', 0 FROM {BATCH} WHERE ord % 5 = 0 AND sync_key IS NOT NULL GROUP BY sync_key)")
def ingest_append(spark, sf_dir):
    """The copy after an ingest: what it had and what was new."""
    old = have(spark, sf_dir).groupBy("sync_key").agg(F.min("ord").alias("ord")).select("ord", "sync_key", F.lit("copy").alias("came"))
    return sync.fresh(batch(spark, sf_dir), have(spark, sf_dir)).select("ord", "sync_key", F.lit("batch").alias("came")).unionByName(old)


PLAN = f"""(SELECT m.*, f.floor_ms FROM {fx.offers_sql()} m JOIN (SELECT o.rig, CASE WHEN max(newest) IS NULL THEN {NOW - sync.FIRST_MS} WHEN count(*) FILTER (WHERE o.seen_ms <= newest) > max(theirs) THEN 0 ELSE max(newest) - {sync.OVERLAP_MS} END AS floor_ms
  FROM {fx.offers_sql()} o LEFT JOIN (SELECT rig, max(seen_ms) AS newest, count(*) AS theirs FROM {FAR} GROUP BY rig) t ON t.rig = o.rig GROUP BY o.rig) f ON f.rig = m.rig WHERE coalesce(m.seen_ms, 0) >= f.floor_ms)"""


@query(f"SELECT rig, ord, floor_ms, (row_number() OVER (PARTITION BY rig ORDER BY ord) - 1) // {sync.CHUNK} AS chunk FROM {PLAN}")
def sync_plan(spark, sf_dir):
    return sync.plan(fx.offers(spark, sf_dir), far(spark, sf_dir), ["rig"], F.lit(NOW)).select("rig", "ord", "floor_ms", "chunk")


def lines(spark, sf_dir):
    """Journal lines of every kind, with numbers in several spellings and damage."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"))
    o = F.col("ord").cast("string")
    line = (
        F.when(F.col("ord") % 7 == 0, F.concat(F.lit('{"kind":"mark","id":"'), o, F.lit('","at":1e3,"hidden":true}')))
        .when(F.col("ord") % 7 == 1, F.concat(F.lit('{"id":'), o, F.lit(',"seq":1.0,"pay":7.5}')))
        .when(F.col("ord") % 7 == 2, F.concat(F.lit('{"id":"a/'), o, F.lit('","seq":2}')))
        .when(F.col("ord") % 7 == 3, F.concat(F.lit('{"id":null,"seq":'), o, F.lit("}")))
        .when(F.col("ord") % 7 == 4, F.concat(F.lit('{"id":'), o)).when(F.col("ord") % 7 == 5, "[1,2]").otherwise("  ")
    )
    return e.select("ord", line.alias("line"))


@query("""SELECT event_id AS ord, CASE event_id % 7 WHEN 4 THEN 'torn' WHEN 5 THEN 'not an object' WHEN 6 THEN 'blank' END AS reason,
  CASE event_id % 7 WHEN 0 THEN '["m","' || event_id || '",1000.0,null,true]' WHEN 1 THEN '["o",' || event_id || '.0,1.0]' WHEN 2 THEN '["o","a/' || event_id || '",2.0]' END AS sync_key FROM events""")
def journal_scan(spark, sf_dir):
    p = jl.parse_lines(lines(spark, sf_dir))
    return p.select("ord", "reason", F.when(F.col("reason").isNull(), jl.sync_key(F.col("row"))).alias("sync_key"))
