"""Queries of the journal's read model."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import journal
from offerloom.plans.base import query
from offerloom.sources import fixtures as fx

R, M, U = fx.readings_sql(), fx.marks_sql(), fx.rules_sql()
VOTED = f"""(SELECT * EXCLUDE (pick) FROM (
  SELECT *, row_number() OVER (PARTITION BY rig, id ORDER BY score DESC, ord DESC) AS pick, min(ord) OVER (PARTITION BY rig, id) AS first_ord, count(*) OVER (PARTITION BY rig, id) AS readings
  FROM (SELECT a.*, coalesce((SELECT sum(CASE WHEN b.pay IS NOT DISTINCT FROM a.pay THEN 3 ELSE 0 END + CASE WHEN b.minutes IS NOT DISTINCT FROM a.minutes THEN 2 ELSE 0 END
        + CASE WHEN a.miles IS NOT NULL AND b.miles = a.miles THEN 2 ELSE 0 END) FROM {R} b WHERE b.rig = a.rig AND b.id = a.id AND b.ord <> a.ord), 0)
      - CASE WHEN a.suspect THEN 1000 ELSE 0 END - CASE WHEN a.whole IS NOT DISTINCT FROM false THEN 100 ELSE 0 END
      - CASE WHEN a.miles IS NULL AND EXISTS (SELECT 1 FROM {R} b WHERE b.rig = a.rig AND b.id = a.id AND b.miles IS NOT NULL) THEN 3 ELSE 0 END AS score FROM {R} a)) WHERE pick = 1)"""
MARKS = f"(SELECT rig, id, arg_max(accepted, ord) FILTER (WHERE accepted IS NOT NULL) AS ma, arg_max(hidden, ord) FILTER (WHERE hidden IS NOT NULL) AS mh FROM {M} GROUP BY rig, id)"
RULES = f"(SELECT rig AS rr, pay AS rp, minutes AS rm, miles AS rd, arg_max(hidden, ord) AS rh FROM {U} WHERE hidden IS NOT NULL GROUP BY ALL)"
LATEST = f"""(SELECT v.* REPLACE (coalesce(mh, rh, v.hidden) AS hidden, coalesce(ma, v.accepted) AS accepted) FROM {VOTED} v LEFT JOIN {MARKS} m ON m.id = v.id AND m.rig = v.rig
  LEFT JOIN {RULES} r ON r.rr = v.rig AND r.rp IS NOT DISTINCT FROM v.pay AND r.rm IS NOT DISTINCT FROM v.minutes AND r.rd IS NOT DISTINCT FROM v.miles)"""
FLOOR = 1_705_000_000_000


def latest(spark, sf_dir):
    return journal.latest(fx.readings(spark, sf_dir), fx.marks(spark, sf_dir), fx.rules(spark, sf_dir))


@query(f"SELECT rig, id, ord, seq, pay, minutes, miles, score::BIGINT AS score, readings FROM {VOTED}")
def best_reading_vote(spark, sf_dir):
    return journal.vote(fx.readings(spark, sf_dir)).select("rig", "id", "ord", "seq", "pay", "minutes", "miles", "score", "readings")


@query(f"SELECT rig, id, arg_max(pay, n * 1000000 + pay) AS pay, max(n) AS votes FROM (SELECT rig, id, pay, count(*) AS n FROM {R} GROUP BY ALL) GROUP BY rig, id")
def consensus_mode(spark, sf_dir):
    return journal.consensus(fx.readings(spark, sf_dir), ["rig", "id"], "pay")


@query(f"SELECT rig, id, ma AS mark_accepted, mh AS mark_hidden FROM {MARKS}")
def journal_marks(spark, sf_dir):
    return journal.fold_marks(fx.marks(spark, sf_dir))


@query(f"SELECT rr AS rig, rp AS pay, rm AS minutes, rd AS miles, rh AS rule_hidden FROM {RULES}")
def journal_rules(spark, sf_dir):
    return journal.fold_rules(fx.rules(spark, sf_dir))


@query(f"SELECT rig, id, ord, pay, minutes, miles, accepted, hidden, seen_ms FROM {LATEST}")
def journal_latest(spark, sf_dir):
    return latest(spark, sf_dir).select("rig", "id", "ord", "pay", "minutes", "miles", "accepted", "hidden", "seen_ms")


@query(f"SELECT rig, id, pay, seen_ms FROM {LATEST} WHERE coalesce(seen_ms, 0) >= {FLOOR} AND NOT coalesce(hidden, false)")
def journal_window(spark, sf_dir):
    return journal.visible(journal.window(latest(spark, sf_dir), F.lit(FLOOR))).select("rig", "id", "pay", "seen_ms")


@query(f"SELECT rig, id, pay FROM (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY coalesce(seen_ms, 0) DESC, first_ord DESC) AS nth FROM {LATEST} WHERE NOT coalesce(hidden, false)) WHERE nth <= 50")
def journal_tail(spark, sf_dir):
    return journal.tail(journal.visible(latest(spark, sf_dir)), 50).select("rig", "id", "pay")


@query(f"SELECT rig, count(*) AS in_window, count(*) FILTER (WHERE hidden) AS hidden_rows, count(*) FILTER (WHERE NOT coalesce(hidden, false)) AS total FROM {LATEST} WHERE coalesce(seen_ms, 0) >= {FLOOR} GROUP BY rig")
def journal_hidden_counts(spark, sf_dir):
    return journal.hidden_counts(journal.window(latest(spark, sf_dir), F.lit(FLOOR)), ["rig"])


@query(f"""SELECT rig, id, concat_ws(',', rig::VARCHAR, id::VARCHAR, seq::VARCHAR, coalesce((minutes::BIGINT)::VARCHAR, ''), CASE WHEN accepted IS NULL THEN '' WHEN accepted THEN '1' ELSE '0' END,
  CASE WHEN hidden IS NULL THEN '' WHEN hidden THEN '1' ELSE '0' END, '"card ' || repeat('"', 2) || id || repeat('"', 3), '"' || strftime(make_timestamp(seen_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z"') AS line FROM {LATEST}""")
def journal_csv(spark, sf_dir):
    rows = latest(spark, sf_dir).withColumn("note", F.concat(F.lit('card "'), F.col("id"), F.lit('"')))
    return journal.csv_lines(rows, ["rig", "id", "seq", "minutes", "accepted", "hidden", "note"]).select("rig", "id", "line")


@query(f"SELECT rig, max(seen_ms) FILTER (WHERE kind = 'offer') AS newest_ms, count(*) FILTER (WHERE kind = 'offer') AS offers, count(*) AS rows FROM (SELECT rig, seen_ms, 'offer' AS kind FROM {R} UNION ALL SELECT rig, 9999999999999, 'mark' FROM {M}) GROUP BY rig")
def newest_watermark(spark, sf_dir):
    marks = fx.marks(spark, sf_dir).select("rig", F.lit(9999999999999).alias("seen_ms"), F.lit("mark").alias("kind"))
    return journal.newest(fx.readings(spark, sf_dir).select("rig", "seen_ms", F.lit("offer").alias("kind")).unionByName(marks), ["rig"])
