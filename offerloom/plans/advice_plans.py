"""Queries of the advice family."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import advice
from offerloom.plans.base import query
from offerloom.sources import fixtures as fx

TH = f"(SELECT unnest([{', '.join(map(str, advice.THRESHOLDS))}]) AS threshold)"


def usable_sql(variant: str = "uniform") -> str:
    return f"""(SELECT rig, ord, seen_ms, pay - 0.3::DOUBLE * coalesce(miles, 0) AS net, minutes AS mins, coalesce(accepted, false) AS took, (pay - 0.3::DOUBLE * coalesce(miles, 0)) / (minutes / 60) AS per_hour
  FROM {fx.offers_sql(variant)} WHERE NOT coalesce(hidden, false) AND NOT coalesce(suspect, false) AND whole IS DISTINCT FROM false AND pay IS NOT NULL AND minutes > 0)"""


def idle_sql(variant: str = "uniform") -> str:
    return f"(SELECT *, seen_ms - lag(CASE WHEN took THEN seen_ms + mins * 60000 ELSE seen_ms::DOUBLE END) OVER (PARTITION BY rig ORDER BY seen_ms, ord) AS idle_ms FROM {usable_sql(variant)})"


def segments_sql(variant: str = "uniform") -> str:
    return f"""(SELECT * FROM (SELECT *, count(*) OVER g AS run_rows, max(seen_ms) OVER g - min(seen_ms) OVER g AS span FROM (
    SELECT *, sum(CASE WHEN idle_ms > threshold * 60000.0 THEN 1 ELSE 0 END) OVER (PARTITION BY rig, threshold ORDER BY seen_ms, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM {idle_sql(variant)}, {TH})
  WINDOW g AS (PARTITION BY rig, threshold, run)) WHERE run_rows > 1 AND span > 0)"""


def steps_sql(variant: str = "uniform") -> str:
    return f"""(SELECT *, CASE WHEN busy_ms = 0 THEN 0 ELSE (earned_cents / 100.0::DOUBLE) / (busy_ms / 3600000.0::DOUBLE) END AS per_hour, busy_ms / 3600000.0::DOUBLE AS hrs FROM (
    SELECT rig, threshold, target, sum(round(r.e * 100)::BIGINT)::BIGINT AS earned_cents, sum(round(greatest(last_ms::DOUBLE, r.b) - first_ms)::BIGINT)::BIGINT AS busy_ms, sum(r.n)::BIGINT AS trips, sum(offers)::BIGINT AS seen
    FROM (SELECT *, list_reduce(os, lambda a, x: CASE WHEN x.s < a.b OR x.p < target THEN a ELSE {{'s': a.s, 'b': x.s + x.m * 60000.0::DOUBLE, 'p': a.p, 'm': a.m, 'w': a.w, 'e': a.e + x.w, 'n': a.n + 1}} END,
        {{'s': 0::DOUBLE, 'b': -1::DOUBLE, 'p': 0::DOUBLE, 'm': 0::DOUBLE, 'w': 0::DOUBLE, 'e': 0::DOUBLE, 'n': 0::BIGINT}}) AS r
      FROM (SELECT rig, threshold, run, count(*) AS offers, min(seen_ms) AS first_ms, max(seen_ms) AS last_ms,
          list({{'s': seen_ms::DOUBLE, 'b': 0::DOUBLE, 'p': per_hour, 'm': mins, 'w': net, 'e': 0::DOUBLE, 'n': 0::BIGINT}} ORDER BY seen_ms, ord) AS os FROM {segments_sql(variant)} GROUP BY ALL), (SELECT unnest(range(0, 61)) AS target))
    GROUP BY ALL))"""


def best_sql(steps: str) -> str:
    return f"(SELECT rig, threshold, target AS best, per_hour AS best_per_hour, trips, hrs, seen FROM (SELECT *, row_number() OVER (PARTITION BY rig, threshold ORDER BY per_hour DESC, target) AS nth FROM {steps} WHERE trips >= 1) WHERE nth = 1 AND per_hour > 0)"


def plateau_sql(steps: str) -> str:
    return f"""(SELECT rig, threshold, best, best_per_hour, min(target) AS low, max(target) AS high FROM (
    SELECT s.rig, s.threshold, best, best_per_hour, target, target - row_number() OVER (PARTITION BY s.rig, s.threshold ORDER BY target) AS island
    FROM {steps} s JOIN {best_sql(steps)} b ON b.rig = s.rig AND b.threshold = s.threshold WHERE s.trips >= 1 AND s.per_hour >= best_per_hour * 0.95::DOUBLE)
  GROUP BY rig, threshold, best, best_per_hour, island HAVING best BETWEEN min(target) AND max(target))"""


def offers(spark, sf_dir, variant="uniform"):
    return fx.offers(spark, sf_dir, variant).withColumn("cost", F.lit(0.3) * F.coalesce("miles", F.lit(0.0)))


def usable(spark, sf_dir):
    return advice.usable(advice.trustworthy(offers(spark, sf_dir)))


def steps(spark, sf_dir):
    return advice.replay(advice.segment(usable(spark, sf_dir)))


@query(f"SELECT rig, count(*) AS offers FROM {fx.offers_sql()} WHERE NOT hidden AND NOT suspect AND whole IS DISTINCT FROM false GROUP BY rig")
def trustworthy_offers(spark, sf_dir):
    return advice.trustworthy(offers(spark, sf_dir)).groupBy("rig").agg(F.count("*").alias("offers"))


@query(f"SELECT rig, ord, seen_ms, net, mins, took, per_hour FROM {usable_sql()}")
def usable_offers(spark, sf_dir):
    return usable(spark, sf_dir)


@query(f"SELECT rig, threshold, run, count(*) AS offers, min(seen_ms) AS first_ms, max(seen_ms) AS last_ms FROM {segments_sql()} GROUP BY ALL")
def runs_segments(spark, sf_dir):
    return advice.runs(advice.segment(usable(spark, sf_dir)))


@query(f"SELECT rig, count(*) FILTER (WHERE idle_ms > 1800000) AS silences, count(*) FILTER (WHERE took) AS tagged FROM {idle_sql()} GROUP BY rig")
def unexplained_silences(spark, sf_dir):
    return advice.unexplained(usable(spark, sf_dir))


@query(f"SELECT rig, target, earned_cents, busy_ms, trips, seen, per_hour FROM {steps_sql()} WHERE threshold = 30")
def replay_ladder(spark, sf_dir):
    return advice.replay(advice.segment(usable(spark, sf_dir), (advice.MAIN_THRESHOLD,))).select("rig", "target", "earned_cents", "busy_ms", "trips", "seen", "per_hour")


@query(f"SELECT rig, threshold, best, best_per_hour, trips FROM {best_sql(steps_sql())}")
def replay_best(spark, sf_dir):
    return advice.answers(steps(spark, sf_dir)).select("rig", "threshold", "best", "best_per_hour", "trips")


@query(f"SELECT rig, threshold, best, low, high FROM {plateau_sql(steps_sql())}")
def replay_plateau(spark, sf_dir):
    return advice.answers(steps(spark, sf_dir)).select("rig", "threshold", "best", "low", "high")


@query(f"SELECT rig, count(*) AS thresholds, max(low) - min(low) AS spread_low, max(high) - min(high) AS spread_high FROM {plateau_sql(steps_sql())} GROUP BY rig")
def threshold_sweep(spark, sf_dir):
    return advice.spreads(advice.answers(steps(spark, sf_dir)))


def gates_sql(variant: str) -> str:
    s = steps_sql(variant)
    return f"""SELECT '{variant}' AS variant, rig, reason, low AS suggested FROM (
  SELECT e.rig, low, CASE WHEN coalesce(n, 0) < 40 OR p.best IS NULL OR hrs < 2 OR trips < 6 THEN 'trips' WHEN low <= 0 THEN 'nolinehelps' WHEN sl > 6 OR sh > 6 OR th < 2 THEN 'unsettled' END AS reason
  FROM (SELECT DISTINCT rig FROM {fx.offers_sql(variant)}) e LEFT JOIN (SELECT rig, count(*) AS n FROM {usable_sql(variant)} GROUP BY rig) u ON u.rig = e.rig
  LEFT JOIN (SELECT * FROM {plateau_sql(s)} WHERE threshold = 30) p ON p.rig = e.rig LEFT JOIN (SELECT * FROM {best_sql(s)} WHERE threshold = 30) b ON b.rig = e.rig
  LEFT JOIN (SELECT rig, max(low) - min(low) AS sl, max(high) - min(high) AS sh, count(*) AS th FROM {plateau_sql(s)} GROUP BY rig) t ON t.rig = e.rig)"""


VARIANTS = ("uniform", "two_tier", "flat", "thin")


@query("SELECT variant, rig, reason, CASE WHEN reason IS NULL THEN suggested END AS suggested FROM (" + " UNION ALL ".join(gates_sql(v) for v in VARIANTS) + ")")
def advise_gates(spark, sf_dir):
    """Each variant of the offers leads to another gate."""
    out = None
    for v in VARIANTS:
        one = advice.advise(offers(spark, sf_dir, v)).select(F.lit(v).alias("variant"), "rig", "reason", "suggested")
        out = one if out is None else out.unionByName(one)
    return out
