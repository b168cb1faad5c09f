"""Queries over frames, words and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import geometry
from offerloom.operators import frames
from offerloom.plans.base import query
from offerloom.sources import fixtures as fx

DIFFS = "(SELECT user_id % 4 AS rig, event_id AS ord, epoch_us(ts) // 1000 AS seen_ms, (event_id * 31) % 11 AS diff, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id // 3) % 4 END AS sig FROM events)"


def diffs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("user_id % 4 AS rig", "event_id AS ord", "unix_micros(CAST(ts AS TIMESTAMP)) div 1000 AS seen_ms", "(event_id * 31) % 11 AS diff", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id div 3) % 4 END AS sig")


W = "PARTITION BY rig ORDER BY seen_ms, ord"


@query(f"""SELECT rig, ord, agreeing, agreeing >= 2 AS locked FROM (SELECT *, row_number() OVER (PARTITION BY rig, island ORDER BY seen_ms, ord) AS agreeing FROM (
  SELECT *, sum(CASE WHEN p IS NOT NULL AND sig IS NOT DISTINCT FROM s THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, lag(ord) OVER ({W}) AS p, lag(sig) OVER ({W}) AS s FROM {DIFFS})))""")
def agreement_lock(spark, sf_dir):
    return frames.agreement(diffs(spark, sf_dir), ["rig"], ["sig"]).select("rig", "ord", F.col("agreeing").cast("long").alias("agreeing"), "locked")


@query(f"""SELECT rig, ord, coalesce(ev = 0 AND last_value(ev IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS read
  FROM (SELECT *, CASE WHEN diff > 6 OR lag(ord) OVER ({W}) IS NULL THEN 1 WHEN diff <= 2 THEN 0 END AS ev FROM {DIFFS})""")
def motion_gate(spark, sf_dir):
    return frames.motion_gate(diffs(spark, sf_dir), ["rig"]).select("rig", "ord", "read")


@query(f"""SELECT rig, ord, round(least(12.0::DOUBLE, 2.5::DOUBLE * pow(1.6::DOUBLE, row_number() OVER (PARTITION BY rig, island ORDER BY seen_ms, ord) - 1)), 6) AS wait FROM (
  SELECT *, sum(CASE WHEN sig IS NULL OR s IS DISTINCT FROM sig THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(sig) OVER ({W}) AS s FROM {DIFFS}))""")
def verify_backoff(spark, sf_dir):
    return frames.verify_wait(diffs(spark, sf_dir), ["rig"], "sig").select("rig", "ord", F.round("wait", 6).alias("wait"))


@query(f"SELECT rig, ord FROM (SELECT *, lag(sig) OVER ({W}) AS s FROM {DIFFS}) WHERE sig IS NOT NULL AND s IS DISTINCT FROM sig")
def error_log(spark, sf_dir):
    return frames.error_islands(diffs(spark, sf_dir), ["rig"], "sig").select("rig", "ord")


@query(f"SELECT rig, ord, seen_ms, diff FROM (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY seen_ms DESC, ord DESC) AS nth FROM {DIFFS}) WHERE nth = 1")
def live_view(spark, sf_dir):
    return frames.live_view(diffs(spark, sf_dir), ["rig"]).select("rig", "ord", "seen_ms", "diff")


LINES = f"""(SELECT page, block, par, line, min(top) AS top, max(top + height) AS bottom, min("left") AS "left", max("left" + width) AS "right",
  array_to_string(list(text ORDER BY nth, "left", top, text), ' ') AS text, min(nth) AS first FROM {fx.WORDS_SQL} GROUP BY page, block, par, line)"""


@query(f"SELECT * FROM {LINES}")
def ocr_lines(spark, sf_dir):
    return frames.ocr_lines(fx.words(spark, sf_dir), ["page"])


@query(f"SELECT page, min(top) FILTER (WHERE contains(text, '$')) AS payout_top, coalesce(min(top) FILTER (WHERE contains(text, '$')) <= 1000 * 0.02, false) AS clipped FROM {LINES} GROUP BY page")
def clipped_payout(spark, sf_dir):
    return frames.clipped_payout(frames.ocr_lines(fx.words(spark, sf_dir), ["page"]), ["page"], F.lit(1000))


SHOTS = "(SELECT user_id % 4 AS rig, event_id % 12 AS exposure, max((event_id * 13) % 100) / 1000.0::DOUBLE AS clipped, min((event_id * 7) % 9) AS banding, sum(event_id % 300) % 256 AS brightness FROM events GROUP BY ALL)"


@query(f"""SELECT rig, arg_min(exposure, abs(brightness - 205) * 1000 + exposure) AS exposure FROM (SELECT *, min(banding) OVER (PARTITION BY rig) AS least_b FROM (
  SELECT *, bool_or(clipped <= 0.08) OVER (PARTITION BY rig) AS any_ok FROM {SHOTS}) WHERE clipped <= 0.08 OR NOT any_ok) WHERE banding <= least_b + 1 GROUP BY rig""")
def exposure_choice(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"rig": F.col("user_id") % 4, "exposure": F.col("event_id") % 12})
    shots = e.groupBy("rig", "exposure").agg((F.max((F.col("event_id") * 13) % 100) / 1000.0).alias("clipped"), F.min((F.col("event_id") * 7) % 9).alias("banding"), (F.sum(F.col("event_id") % 300) % 256).alias("brightness"))
    return frames.exposure_choice(shots, ["rig"])


@query("""SELECT ord, round((w1 + w2) / 2, 6) AS width, round((h1 + h2) / 2, 6) AS height, cx, cy FROM (SELECT event_id AS ord, sqrt((200 + a) * (200 + a) + b * b)::DOUBLE AS w1, sqrt((210 + b) * (210 + b) + (a - b) * (a - b))::DOUBLE AS w2,
    sqrt(0 + (400 + b) * (400 + b))::DOUBLE AS h1, sqrt((10 - a + b) * (10 - a + b) + (400 - b + a) * (400 - b + a))::DOUBLE AS h2, (0 + 200 + a + 210 + b + 0) / 4.0::DOUBLE AS cx, (0 + b + 400 + a + 400 + b) / 4.0::DOUBLE AS cy
  FROM (SELECT event_id, (event_id * 7) % 20 AS a, (event_id * 3) % 15 AS b FROM events))""")
def quad_metrics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS ord", "CAST((event_id * 7) % 20 AS DOUBLE) AS a", "CAST((event_id * 3) % 15 AS DOUBLE) AS b")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, a, b = F.lit(0.0), F.col("a"), F.col("b")
    q = e.withColumn("q", F.array(p(210 + b, 400 + a), p(zero, 400 + b), p(zero, zero), p(200 + a, b))).withColumn("q", geometry.order_corners(F.col("q")))
    c = geometry.centre(F.col("q"))
    return q.select("ord", F.round(geometry.width(F.col("q")), 6).alias("width"), F.round(geometry.height(F.col("q")), 6).alias("height"), c["x"].alias("cx"), c["y"].alias("cy"))


# Frames of 6 rows and 8 pixels from each event; three events are the frames of a shot, whose rows ripple at some settings.
_LUMA = "SELECT event_id // 3 AS shot, event_id % 3 AS nth, (event_id // 3) % 12 AS exposure, (event_id // 36) % 4 AS rig, {pixels} AS luma FROM {events}"
_PIXEL = "least(255, (event_id // 3 * 31 + r * 37 + c * 13) % 180 + 20 * ((event_id // 3) % 6) + CASE WHEN (event_id // 3) % 4 > 1 THEN (r + event_id) % 3 * 25 ELSE 0 END)"
_SQL_ROWS = f"list_transform(generate_series(0, 5 - event_id % 2), lambda r: list_transform(generate_series(0, 7), lambda c: {_PIXEL}))"
_SPARK_ROWS = f"transform(sequence(0L, 5 - event_id % 2), r -> transform(sequence(0L, 7L), c -> {_PIXEL}))".replace("//", "DIV")
LUMA = _LUMA.format(pixels=_SQL_ROWS, events="events")


def shots(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_LUMA.replace("//", "DIV").format(pixels=_SPARK_ROWS, events="{events}"), events=e)


_SCORES = f"""WITH f AS (SELECT *, list_transform(luma, lambda r: list_avg(list_transform(r, lambda x: x::DOUBLE))) AS profile, flatten(luma) AS pixels FROM ({LUMA})),
p AS (SELECT *, min(len(profile)) OVER (PARTITION BY shot) AS n, lag(profile) OVER (PARTITION BY shot ORDER BY nth) AS before FROM f)
SELECT rig, exposure, shot, round(coalesce(avg(list_avg(list_transform(list_zip(profile[1:n], before[1:n]), lambda z: abs(z[1] - z[2])))) FILTER (WHERE before IS NOT NULL), 0), 6) AS banding,
  round(arg_min(list_aggregate(pixels, 'quantile_cont', 0.9), nth), 6) AS brightness, round(arg_min(len(list_filter(pixels, lambda x: x >= 250)) / len(pixels)::DOUBLE, nth), 6) AS clipped FROM p GROUP BY rig, exposure, shot"""


@query(_SCORES)
def exposure_scores(spark, sf_dir):
    told = frames.exposure_scores(shots(spark, sf_dir), ["rig", "exposure", "shot"])
    return told.select("rig", "exposure", "shot", *(F.round(c, 6).alias(c) for c in ("banding", "brightness", "clipped")))


@query(f"""SELECT rig, round_, arg_min(exposure, abs(brightness - 205) * 1000 + exposure) AS exposure FROM (SELECT *, min(banding) OVER (PARTITION BY rig, round_) AS least_b FROM (
  SELECT *, shot // 48 AS round_, bool_or(clipped <= 0.08) OVER (PARTITION BY rig, shot // 48) AS any_ok FROM ({_SCORES})) WHERE clipped <= 0.08 OR NOT any_ok) WHERE banding <= least_b + 1 GROUP BY rig, round_""")
def exposure_chosen(spark, sf_dir):
    """The exposure of each round of calibration, from its frames' pixels."""
    told = exposure_scores(spark, sf_dir).withColumn("round_", F.floor(F.col("shot") / 48).cast("long"))
    return frames.exposure_choice(told, ["rig", "round_"])


# Pictures of 21 pixels: ground and ink change ends every 50 events, and often the ground is near the middle.
_CARDS = "SELECT user_id % 4 AS rig, event_id AS ord, {ms} AS seen_ms, CASE WHEN event_id % 31 > 0 THEN {pixels} END AS pixels FROM {events}"
_INK = "CASE WHEN i < 3 THEN 20 + event_id % 7 WHEN i > 17 THEN 220 - event_id % 5 ELSE 120 + CASE event_id % 3 WHEN 0 THEN (event_id * 7) % 16 - 8 ELSE CASE WHEN (event_id // 50) % 2 = 0 THEN 60 ELSE -60 END + event_id % 9 END END"
PICTURES = _CARDS.format(ms="epoch_us(ts) // 1000", pixels=f"list_transform(generate_series(0, 20), lambda i: {_INK})", events="events")


def pictures(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pixels = f"transform(sequence(0L, 20L), i -> {_INK})".replace("//", "DIV")
    return spark.sql(_CARDS.format(ms="unix_micros(CAST(ts AS TIMESTAMP)) div 1000", pixels=pixels, events="{events}"), events=e)


@query(f"""WITH RECURSIVE d AS (SELECT *, (lo + hi) / 2 AS mid FROM (SELECT rig, ord, seen_ms, list_aggregate(pixels, 'quantile_cont', 0.05) AS lo, list_aggregate(pixels, 'quantile_cont', 0.95) AS hi, list_aggregate(pixels, 'quantile_cont', 0.5) AS ground FROM ({PICTURES}))),
g AS (SELECT *, row_number() OVER ({W}) AS n FROM d),
walk AS (SELECT rig, 0::BIGINT AS n, 0::BIGINT AS ord, NULL::BOOLEAN AS was, NULL::BOOLEAN AS dark FROM (SELECT DISTINCT rig FROM g)
UNION ALL SELECT rig, n, ord, coalesce(dark, s_was), dark FROM (SELECT x.rig, x.n, x.ord, s_was, CASE WHEN s_was IS NOT NULL AND abs(ground - mid) < 0.06 * greatest(1, hi - lo) THEN s_was ELSE ground < mid END AS dark
  FROM (SELECT rig AS r_, n AS n_, was AS s_was FROM walk) s JOIN g x ON x.rig = r_ AND x.n = n_ + 1))
SELECT rig, ord, CASE WHEN ground IS NOT NULL THEN dark END AS dark FROM walk JOIN g USING (rig, n, ord) WHERE n > 0""")
def dark_mode(spark, sf_dir):
    return frames.dark_mode(pictures(spark, sf_dir), ["rig"]).select("rig", "ord", "dark")


# Three candidates a frame: boxes about the middle and beside it, some leaning, some flat.
_BOXES = (
    "SELECT event_id // 3 AS frame, event_id % 3 AS nth, 640.0::DOUBLE AS frame_width, 480.0::DOUBLE AS frame_height, 1.0::DOUBLE * ((event_id * 37) % 420) AS x, 1.0::DOUBLE * ((event_id * 53) % 300) AS y,"
    " 1.0::DOUBLE * CASE WHEN event_id % 17 = 0 THEN 0 ELSE 60 + (event_id * 11) % 200 END AS w, 1.0::DOUBLE * CASE WHEN event_id % 17 = 0 THEN 0 ELSE 80 + (event_id * 7) % 160 END AS h, 1.0::DOUBLE * (event_id % 4 * 8) AS lean FROM {events}"
)


@query(f"""WITH b AS ({_BOXES.format(events='events')}), s AS (SELECT *, w > 0 AND x <= 320 - lean * (240 - y) / h AND 320 - lean * (240 - y) / h <= x + w AND y <= 240 AND 240 <= y + h AS holds,
  sqrt((x + w / 2 + lean / 2 - 320) * (x + w / 2 + lean / 2 - 320) + (y + h / 2 - 240) * (y + h / 2 - 240)) / 640 AS away FROM b),
r AS (SELECT *, CASE WHEN w > 0 THEN away - CASE WHEN holds THEN 1 ELSE 0 END ELSE 1e9 END AS score FROM s)
SELECT frame, arg_min(x, nth) FILTER (WHERE place = 1) AS x, arg_min(y, nth) FILTER (WHERE place = 1) AS y, round(min(score), 6) AS score, count(*) AS candidates
FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(score, 9), nth) AS place FROM r) GROUP BY frame""")
def nearest_centre(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    b = spark.sql(_BOXES.replace("//", "DIV").replace("::DOUBLE", "D").format(events="{events}"), events=e)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h, lean = (F.col(c) for c in ("x", "y", "w", "h", "lean"))
    b = b.withColumn("quad", F.array(p(x, y), p(x + w, y), p(x + w + lean, y + h), p(x + lean, y + h)))
    found = frames.nearest_centre(b, ["frame"])
    return found.select("frame", F.get("quad", 0)["x"].alias("x"), F.get("quad", 0)["y"].alias("y"), F.round("score", 6).alias("score"), "candidates")
