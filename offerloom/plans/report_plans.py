"""Queries of the summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import text
from offerloom.operators import advice, journal, reports
from offerloom.plans.base import query
from offerloom.plans.rating_plans import CARDS, RATED, rated
from offerloom.sources import fixtures as fx

TRUST = f"(SELECT *, make_timestamp(seen_ms * 1000) AS t FROM {RATED} WHERE NOT hidden AND NOT suspect AND whole IS DISTINCT FROM false)"


def rows(spark, sf_dir):
    return advice.trustworthy(rated(spark, sf_dir))


@query(f"SELECT rig, quantile_cont(per_hour, 0.25) AS p25, quantile_cont(per_hour, 0.5) AS p50, quantile_cont(per_hour, 0.75) AS p75 FROM {TRUST} GROUP BY rig")
def offer_quartiles(spark, sf_dir):
    return reports.quartiles(rows(spark, sf_dir), ["rig"])


@query(f"SELECT rig, count(*) AS offers, (count(*) FILTER (WHERE per_hour >= 25))::DOUBLE / count(*) AS share FROM {TRUST} GROUP BY rig")
def target_share(spark, sf_dir):
    return reports.target_share(rows(spark, sf_dir), ["rig"], F.lit(25.0))


@query(f"SELECT rig, hour(t) // 3 AS block, count(*) AS offers, median(per_hour) AS median_per_hour FROM {TRUST} GROUP BY ALL")
def three_hour_blocks(spark, sf_dir):
    return reports.three_hour_blocks(rows(spark, sf_dir), ["rig"])


@query(f"SELECT rig, shop, count(*) AS offers, median(per_hour) AS median_per_hour FROM {TRUST} GROUP BY ALL")
def shop_split(spark, sf_dir):
    return reports.shop_split(rows(spark, sf_dir), ["rig"])


@query(f"SELECT rig, strftime(t, '%Y-%m-%d') AS day, count(*) AS offers, median(per_hour) AS median_per_hour, sum(round(pay * 100)::BIGINT)::BIGINT AS total_cents FROM {TRUST} GROUP BY ALL")
def daily_summary(spark, sf_dir):
    return reports.daily(rows(spark, sf_dir), ["rig"])


@query(f"""SELECT rig, day, count(*) AS offered, sum(c)::BIGINT AS offered_cents, count(*) FILTER (WHERE accepted) AS worked, coalesce(sum(c) FILTER (WHERE accepted), 0)::BIGINT AS worked_cents
  FROM (SELECT rig, strftime(t, '%Y-%m-%d') AS day, round(pay * 100)::BIGINT AS c, accepted FROM {TRUST}) GROUP BY GROUPING SETS ((rig, day), (rig))""")
def worked_vs_offered(spark, sf_dir):
    return reports.worked_and_offered(rows(spark, sf_dir), ["rig"])


@query(f"""SELECT rig, count(*) AS rows, max(per_hour) AS best_per_hour, round(avg(per_hour), 6) AS mean_per_hour, floor(100.0::DOUBLE * count(*) FILTER (WHERE state = 'go') / count(*) + 0.5)::BIGINT AS go_percent
  FROM (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY seen_ms DESC, ord DESC) AS nth FROM {RATED}) WHERE nth <= 100 GROUP BY rig""")
def history_stats(spark, sf_dir):
    return reports.history(rated(spark, sf_dir), ["rig"]).withColumn("mean_per_hour", F.round("mean_per_hour", 6))


@query(f"SELECT ord FROM {CARDS} WHERE kind = 2")
def place_search(spark, sf_dir):
    cards = fx.cards(spark, sf_dir)
    return reports.by_place(cards.withColumn("places", text.find_places(F.col("text"))), "corner BAK").select("ord")


#: Windows one after the other: from each start to the first read two minutes later.
@query(f"""WITH RECURSIVE r AS (SELECT rig, seen_ms, 100 + (ord * 37) % 900 AS ms, ord % 3 > 0 AS c, ord % 10 = 0 AS f FROM {fx.offers_sql()}),
  t AS (SELECT rig, min(seen_ms) AS from_ms FROM r GROUP BY rig
        UNION ALL SELECT t.rig, (SELECT min(seen_ms) FROM r WHERE r.rig = t.rig AND r.seen_ms >= t.from_ms + 120000) FROM t WHERE t.from_ms IS NOT NULL),
  s AS (SELECT rig, from_ms, coalesce(lead(from_ms) OVER (PARTITION BY rig ORDER BY from_ms), 9000000000000000) AS to_ms FROM t WHERE from_ms IS NOT NULL)
  SELECT r.rig, from_ms, count(*) AS reads, count(*) FILTER (WHERE c) AS complete, 0::BIGINT AS no_pay, count(*) FILTER (WHERE f) AS failed, list_sort(list(ms))[count(*) // 2 + 1] AS upper_median_ms
  FROM r JOIN s ON r.rig = s.rig AND seen_ms >= from_ms AND seen_ms < to_ms GROUP BY r.rig, from_ms""")
def health_windows(spark, sf_dir):
    return reports.health(health_reads(spark, sf_dir))


def health_reads(spark, sf_dir):
    return fx.offers(spark, sf_dir).withColumns({"ms": 100 + (F.col("ord") * 37) % 900, "complete": F.col("ord") % 3 > 0, "failed": F.col("ord") % 10 == 0})


@query(f"""SELECT ord, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm ago' WHEN (m + 30) // 60 < 24 THEN (m + 30) // 60 || 'h ago' ELSE ((m + 30) // 60 + 12) // 24 || 'd ago' END AS said
  FROM (SELECT ord, ((ord * 7919 * 101) % 400000000 + 30000) // 60000 AS m FROM {fx.offers_sql()})""")
def ago_buckets(spark, sf_dir):
    return fx.offers(spark, sf_dir).select("ord", reports.ago((F.col("ord") * 7919 * 101) % 400000000).alias("said"))


@query(f"SELECT ord, strftime(make_timestamp(seen_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM {fx.offers_sql()}")
def iso_times(spark, sf_dir):
    return fx.offers(spark, sf_dir).select("ord", journal.iso_time(F.col("seen_ms")).alias("iso"))


@query(f"""SELECT ord, CASE WHEN doubt = 'pay' THEN 'check the pay.' WHEN doubt = 'time' THEN 'check the time.' WHEN doubt = 'speed' THEN 'check the distance.'
  ELSE CASE state WHEN 'go' THEN 'accept' WHEN 'warn' THEN 'close' ELSE 'pass' END || '. ' || round_even(per_hour, 0)::BIGINT || ' an hour.' END AS said FROM {RATED}""")
def spoken_verdict(spark, sf_dir):
    return rated(spark, sf_dir).select("ord", reports.spoken(F.col("state"), F.col("per_hour").cast("double"), F.col("doubt")).alias("said"))


_X = "((ord * 7919) % 40001 - 12000) / 64.0"


@query(f"""SELECT ord, CASE WHEN x < 0 THEN '-$' ELSE '$' END || printf('%.2f', abs(x)) AS money, CASE WHEN x < 0 THEN '-$' ELSE '$' END || CASE WHEN abs(x) >= 100 THEN (floor(abs(x) + 0.5)::BIGINT)::VARCHAR
  ELSE printf('%.1f', floor(abs(x) * 10 + 0.5) / 10) END AS rate, floor(x * 10 + 0.5) / 10 AS tenth FROM (SELECT ord, floor(({_X}::DOUBLE) * 8) / 8 + 0.0625 AS x FROM {fx.offers_sql()})""")
def display_figures(spark, sf_dir):
    x = F.floor(F.expr(f"CAST({_X} AS DOUBLE)") * 8) / 8 + 0.0625
    rows = fx.offers(spark, sf_dir).select("ord", x.alias("x"))
    return rows.select("ord", reports.money_text(F.col("x")).alias("money"), reports.rate_text(F.col("x")).alias("rate"), reports.round1(F.col("x")).alias("tenth"))


@query(f"""SELECT rig, stage, median(ms)::DOUBLE AS median_ms FROM (SELECT rig, 'find' AS stage, (ord * 7) % 90 AS ms FROM {fx.offers_sql()} UNION ALL SELECT rig, 'read', 100 + (ord * 37) % 900 FROM {fx.offers_sql()}) GROUP BY ALL""")
def stage_medians(spark, sf_dir):
    rows = fx.offers(spark, sf_dir).withColumns({"find": (F.col("ord") * 7) % 90, "read": 100 + (F.col("ord") * 37) % 900})
    return reports.stage_medians(rows, ["rig"], ["find", "read"])
