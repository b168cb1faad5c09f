"""Queries of the machines: trackers, gains and gates over tables and, batch by batch, over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators import reports
from offerloom.plans import frame_plans, record_plans, report_plans
from offerloom.plans.base import ORACLES, query
from offerloom.plans.stream_plans import BATCH_ROWS, SINGLE_ROWS, drain
from offerloom.streaming import controllers as c
from offerloom.streaming import gates
from offerloom.streaming.machines import LATENESS_MS, fold, live


def events(spark, sf_dir, sql: str) -> DataFrame:
    plain = sql.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}")  # braces of JSON are text
    return spark.sql(plain.replace(" // ", " DIV ").replace("::DOUBLE", "D"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def streamed(spark, rows: DataFrame, machine, name: str, initial: DataFrame | None = None) -> DataFrame:
    """``rows``, in several micro-batches by time, through a machine as a stream."""
    return drain(spark, rows, lambda s: live(s, machine, initial), name, most=SINGLE_ROWS if machine.TIMED else BATCH_ROWS)


# Walks in SQL: rows of a rig one by one, each state kept; layers name what the next ones use.


def walk(source: str, state: dict[str, str], layers: list[dict[str, str]], after: dict[str, str], result: str) -> str:
    """``state``: each field's start; ``layers``: named expressions over the row, ``s_`` fields and earlier layers;
    ``after``: each field's new value."""
    inner = f"SELECT x.*, {', '.join(f's_{f}' for f in state)} FROM (SELECT rig AS r_, n AS n_, {', '.join(f'{f} AS s_{f}' for f in state)} FROM walk) s JOIN g x ON x.rig = r_ AND x.n = n_ + 1"
    for layer in layers:
        inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({inner})"
    return f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY ts_ms, ord) AS n FROM ({source})),
  walk AS (SELECT rig, 0::BIGINT AS n, 0::BIGINT AS ord, {', '.join(f'{e} AS {f}' for f, e in state.items())} FROM (SELECT DISTINCT rig FROM g)
  UNION ALL SELECT rig, n, ord, {', '.join(f'{after[f]} AS {f}' for f in state)} FROM ({inner}))
  SELECT {result} FROM walk WHERE n > 0"""


#: Outlines as a detector may give them: steady, drifting, moved, back, smaller for long, gone, a strip, here and there.
_BOX = (
    "CASE (event_id // 250) % 8 WHEN 0 THEN [400 + j, 200, 700, 1500] WHEN 1 THEN [430 + j, 210, 700, 1500] WHEN 2 THEN [820 + j, 300, 700, 1500] WHEN 3 THEN [410, 200 + j, 700, 1500]"
    " WHEN 4 THEN [505, 425, 490 + j, 1050] WHEN 5 THEN CASE WHEN event_id % 3 = 0 THEN [505, 425, 490, 1050] END WHEN 6 THEN [100, 1700 + j, 1340, 230] ELSE [400 + 90 * (event_id % 5), 200, 700, 1500] END"
)
_OUTLINES = (
    "SELECT rig, ord, ts_ms, event_id_reset AS reset, 1536.0::DOUBLE AS frame_width, 2048.0::DOUBLE AS frame_height, CASE WHEN x IS NOT NULL THEN"
    " {array}(x * 1.0::DOUBLE, y * 1.0::DOUBLE, (x + w) * 1.0::DOUBLE, y * 1.0::DOUBLE, (x + w) * 1.0::DOUBLE, (y + h) * 1.0::DOUBLE, x * 1.0::DOUBLE, (y + h) * 1.0::DOUBLE) END AS quad"
    " FROM (SELECT rig, ord, ts_ms, event_id_reset, {x} AS x, {y} AS y, {w} AS w, {h} AS h FROM (SELECT user_id % 4 AS rig, event_id AS ord, 60000 + event_id * 150 AS ts_ms, event_id % 977 = 976 AS event_id_reset, {box} AS b"
    " FROM (SELECT *, (event_id * 7) % 5 AS j FROM {events})))"
)
OUTLINES = _OUTLINES.format(array="list_value", x="b[1]", y="b[2]", w="b[3]", h="b[4]", box=_BOX, events="events")


def outlines(spark, sf_dir) -> DataFrame:
    box = _BOX.replace("[", "array(").replace("]", ")")
    return events(spark, sf_dir, _OUTLINES.format(array="array", x="b[0]", y="b[1]", w="b[2]", h="b[3]", box=box, events="{events}"))


FIRST = [400.0, 200.0, 1100.0, 200.0, 1100.0, 1700.0, 400.0, 1700.0]


def screens(spark, sf_dir) -> DataFrame:
    """Each rig's screen as calibrated."""
    return outlines(spark, sf_dir).select("rig").distinct().withColumn("quad", F.array(*map(F.lit, FIRST)))


_len = lambda a, i, b, j: f"sqrt(({a}[{2 * i + 1}] - {b}[{2 * j + 1}]) * ({a}[{2 * i + 1}] - {b}[{2 * j + 1}]) + ({a}[{2 * i + 2}] - {b}[{2 * j + 2}]) * ({a}[{2 * i + 2}] - {b}[{2 * j + 2}]))"
_apart = lambda a, b: f"(({' + '.join(_len(a, i, b, i) for i in range(4))}) / 4)"
_span = lambda q: f"(({_len(q, 0, q, 2)} + {_len(q, 1, q, 3)}) / 2)"
_aspect = lambda q: f"((({_len(q, 0, q, 3)} + {_len(q, 1, q, 2)}) / 2) / greatest(({_len(q, 0, q, 1)} + {_len(q, 3, q, 2)}) / 2, 1))"
_near = lambda a, b, share: f"({_apart(a, b)} <= {share} * greatest({_span(b)}, 1))"
_holds = lambda q: f"({q}[1] <= 768 AND 768 <= {q}[3] AND {q}[2] <= 1024 AND 1024 <= {q}[6])"  # noqa: E731  (upright boxes)
_T = "coalesce({}, false)"
_JUMPS = "('stalled', 'centred', 'adopted')"
TRACKER_SQL = walk(
    OUTLINES,
    {"quad": f"{FIRST}::DOUBLE[]", "cal": f"{FIRST}::DOUBLE[]", "last": "NULL::DOUBLE[]", "agree": "0::BIGINT", "miss": "0::BIGINT", "checked": "NULL::BIGINT", "disputed": "NULL::BIGINT",
     "off": "NULL::BIGINT", "stuck": "NULL::BIGINT", "stuck_on": "NULL::DOUBLE[]", "verdict": "''", "moves": "0::BIGINT", "jumps": "0::BIGINT", "resets": "0::BIGINT", "ts": "0::BIGINT"},
    [
        {"early": "s_checked IS NOT NULL AND ts_ms - s_checked < 400", "again": _T.format(_near("quad", "s_last", 0.06)), "close_by": _near("quad", "s_quad", 0.22), "nudge": _near("quad", "s_quad", 0.05),
         "on_it": f"{_apart('quad', 's_quad')} <= 0.06 * greatest({_span('quad')}, 1)", "shape": f"{_aspect('quad')} / greatest({_aspect('s_cal')}, 0.01) BETWEEN 0.70 AND 1 / 0.70::DOUBLE",
         "size": f"{_span('quad')} / greatest({_span('s_cal')}, 1) BETWEEN 0.78 AND 1 / 0.78::DOUBLE", "still": _T.format(_near("quad", "s_stuck_on", 0.06)), "centre": f"{_holds('quad')} AND NOT {_holds('s_quad')}"},
        {"agreed": "CASE WHEN again THEN s_agree + 1 ELSE 1 END", "held": "shape AND NOT on_it AND still"},
        {"v": "CASE WHEN reset THEN 'reset' WHEN early THEN 'early' WHEN quad IS NULL THEN 'miss' WHEN held AND ts_ms - s_stuck >= 30000 THEN 'stalled' WHEN centre AND shape AND agreed >= 2 THEN 'centred'"
              " WHEN NOT (size AND shape) THEN 'refused' WHEN close_by AND (agreed >= 5 OR nudge) THEN 'eased' WHEN NOT close_by AND agreed >= 5 THEN 'adopted' ELSE 'waits' END"},
        {"fresh": f"v IN {_JUMPS} OR v = 'eased' OR v IN ('miss', 'reset')", "looked": "v NOT IN ('reset', 'early')", "seen": "v NOT IN ('reset', 'early', 'miss')"},
    ],
    {"quad": f"CASE WHEN v IN {_JUMPS} THEN quad WHEN v = 'eased' THEN list_transform(list_zip(s_quad, quad), lambda z: z[1] + (z[2] - z[1]) * 0.35::DOUBLE) WHEN v = 'reset' THEN s_cal ELSE s_quad END",
     "cal": "CASE WHEN v IN ('stalled', 'centred') THEN quad ELSE s_cal END", "last": "CASE WHEN v IN ('reset', 'miss', 'refused') THEN NULL WHEN v = 'early' THEN s_last ELSE quad END",
     "agree": f"CASE WHEN v = 'early' THEN s_agree WHEN v IN ('reset', 'miss', 'refused') OR v IN {_JUMPS} THEN 0 ELSE agreed END",
     "miss": "CASE WHEN v = 'early' THEN s_miss WHEN v = 'miss' THEN s_miss + 1 ELSE 0 END", "checked": "CASE WHEN looked THEN ts_ms ELSE s_checked END",
     "disputed": "CASE WHEN v = 'early' THEN s_disputed WHEN v IN ('reset', 'miss', 'refused') OR close_by THEN NULL ELSE coalesce(s_disputed, ts_ms) END",
     "off": "CASE WHEN fresh OR seen AND on_it THEN NULL WHEN v = 'early' THEN s_off ELSE coalesce(s_off, ts_ms) END",
     "stuck": "CASE WHEN fresh OR seen AND shape AND on_it THEN NULL WHEN seen AND shape AND NOT still THEN ts_ms ELSE s_stuck END",
     "stuck_on": "CASE WHEN fresh OR seen AND shape AND on_it THEN NULL WHEN seen AND shape AND NOT still THEN quad ELSE s_stuck_on END",
     "verdict": "v", "moves": f"s_moves + CASE WHEN v = 'eased' OR v IN {_JUMPS} THEN 1 ELSE 0 END", "jumps": f"s_jumps + CASE WHEN v IN {_JUMPS} THEN 1 ELSE 0 END",
     "resets": "s_resets + CASE WHEN v = 'reset' THEN 1 ELSE 0 END", "ts": "ts_ms"},
    "rig, ord, verdict, round(quad[1], 3) AS x, round(quad[2], 3) AS y, round(quad[5], 3) AS x2, round(quad[6], 3) AS y2, agree AS agreeing, miss AS misses, coalesce(checked - off >= 5000, false) AS stalled,"
    " coalesce(ts - disputed < 2000, false) AS disputing, moves, jumps, resets",
)


def _tracked(rows: DataFrame) -> DataFrame:
    at = lambda i: F.round(F.get("quad", i), 3)
    return rows.select("rig", "ord", "verdict", at(0).alias("x"), at(1).alias("y"), at(4).alias("x2"), at(5).alias("y2"), "agreeing", "misses", "stalled", "disputing", "moves", "jumps", "resets")


@query(TRACKER_SQL)
def screen_tracker(spark, sf_dir):
    return _tracked(fold(outlines(spark, sf_dir), c.ScreenTracker, initial=screens(spark, sf_dir)))


@query(TRACKER_SQL)
def stream_screen_tracker(spark, sf_dir):
    return _tracked(streamed(spark, outlines(spark, sf_dir), c.ScreenTracker, "tracker", screens(spark, sf_dir)))


#: Brightness of a card: dim, blown out, dark without a screen, right, no picture, a little bright.
_LIGHT = (
    "SELECT user_id % 4 AS rig, event_id AS ord, 60000 + event_id * 1700 AS ts_ms, CASE (event_id // 160) % 6 WHEN 0 THEN 90 + (event_id * 7) % 60 WHEN 1 THEN 250 + event_id % 5 WHEN 2 THEN 5 + event_id % 30"
    " WHEN 3 THEN 190 + event_id % 30 WHEN 4 THEN event_id % 3 * 8 ELSE 226 + event_id % 9 END * 1.0::DOUBLE AS bright,"
    " CASE WHEN (event_id // 160) % 6 = 1 THEN 0.09::DOUBLE + event_id % 7 / 10.0::DOUBLE ELSE event_id % 9 / 100.0::DOUBLE END AS clipped, (event_id // 160) % 6 <> 2 OR event_id % 4 = 0 AS has_screen FROM {events}"
)
_EXPOSURES = f"[{', '.join(map(str, c.EXPOSURES))}]"
_LONGER = f"list_max(list_filter({_EXPOSURES}, lambda e: s_exposure < e AND e <= 16667 AND bright * e / s_exposure <= 205))"
_SHORTER = f"list_max(list_filter({_EXPOSURES}, lambda e: e < s_exposure))"
GAIN_SQL = walk(
    _LIGHT.format(events="events"),
    {"gain": "1.5::DOUBLE", "exposure": "16667::BIGINT", "acted": "NULL::BIGINT", "rule": "''", "moves": "0::BIGINT", "shortened": "0::BIGINT"},
    [
        {"down": "greatest(1.0::DOUBLE, s_gain / 1.18::DOUBLE)", "turn": "least(8.0::DOUBLE, greatest(1.0::DOUBLE, s_gain * CASE WHEN bright < 205 THEN 1.18::DOUBLE ELSE 1 / 1.18::DOUBLE END))", "longer": _LONGER, "shorter": _SHORTER},
        {"v": "CASE WHEN s_acted IS NOT NULL AND ts_ms - s_acted < 6000 THEN 'early' WHEN bright <= 0 THEN 'no picture' WHEN clipped > 0.08::DOUBLE THEN CASE WHEN abs(down - s_gain) >= 0.01::DOUBLE THEN 'lowered'"
              " WHEN shorter IS NOT NULL THEN 'shortened' ELSE 'blown out' END WHEN bright < 205 AND longer IS NOT NULL THEN 'given back' WHEN NOT has_screen OR bright < 20 THEN 'no screen'"
              " WHEN abs(bright - 205) / 205 <= 0.1::DOUBLE THEN 'near enough' WHEN abs(turn - s_gain) < 0.01::DOUBLE THEN 'kept' WHEN bright < 205 THEN 'raised' ELSE 'lowered' END"},
    ],
    {"gain": "CASE WHEN v = 'lowered' AND clipped > 0.08::DOUBLE THEN down WHEN v IN ('raised', 'lowered') THEN turn ELSE s_gain END", "exposure": "CASE v WHEN 'shortened' THEN shorter WHEN 'given back' THEN longer ELSE s_exposure END",
     "acted": "CASE WHEN v = 'early' THEN s_acted ELSE ts_ms END", "rule": "v", "moves": "s_moves + CASE WHEN v IN ('raised', 'lowered') THEN 1 ELSE 0 END", "shortened": "s_shortened + CASE WHEN v = 'shortened' THEN 1 ELSE 0 END"},
    "rig, ord, rule, round(gain, 6) AS gain, exposure, moves, shortened",
)


def light(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, _LIGHT)


def measured(spark, sf_dir) -> DataFrame:
    return light(spark, sf_dir).select("rig").distinct().withColumns({"gain": F.lit(None).cast("double"), "exposure": F.lit(16667).cast("long")})


def _lit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gain", F.round("gain", 6))


@query(GAIN_SQL)
def auto_gain(spark, sf_dir):
    return _lit(fold(light(spark, sf_dir), c.AutoGain, initial=measured(spark, sf_dir)))


@query(GAIN_SQL)
def stream_auto_gain(spark, sf_dir):
    return _lit(streamed(spark, light(spark, sf_dir), c.AutoGain, "gain", measured(spark, sf_dir)))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("seen_ms", "ts_ms")


def _words(rows: DataFrame, *names: str) -> DataFrame:
    """``sig``: what a reading says, as text; null where all of it is."""
    known = F.coalesce(*(F.col(n).cast("string") for n in names)).isNotNull()
    return rows.withColumn("sig", F.when(known, F.to_json(F.struct(*names))))


@query(ORACLES["motion_gate"])
def stream_motion_gate(spark, sf_dir):
    return streamed(spark, _timed(frame_plans.diffs(spark, sf_dir)).select("rig", "ord", "ts_ms", "diff"), gates.MotionGate, "motion")


@query(ORACLES["agreement_lock"])
def stream_agreement_lock(spark, sf_dir):
    return streamed(spark, _words(_timed(frame_plans.diffs(spark, sf_dir)), "sig").select("rig", "ord", "ts_ms", "sig"), gates.Agreement, "agreement")


@query(ORACLES["browser_lock"])
def stream_browser_lock(spark, sf_dir):
    return streamed(spark, record_plans.page_readings(spark, sf_dir), gates.PageLock, "page")


@query(ORACLES["aiming_gate"])
def stream_aiming_gate(spark, sf_dir):
    return streamed(spark, _timed(record_plans.gates(spark, sf_dir)).selectExpr("rig", "ord", "ts_ms", "whole OR stable AS good"), gates.Aim, "aim")


@query(ORACLES["speak_once"])
def stream_speak_once(spark, sf_dir):
    return streamed(spark, _timed(record_plans.gates(spark, sf_dir)).select("rig", "ord", "ts_ms", "pay", "minutes", "ready", "locked", "whole"), gates.SpeakOnce, "speak")


#: Readings 350 ms apart over four rigs; the figures change now and then, some are whole and stable, some rigs pause.
_VIEWS = (
    "SELECT user_id % 4 AS rig, event_id AS ord, 60000 + event_id * 350 + (event_id // 40) * 30000 AS ts_ms, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 5.0::DOUBLE + (event_id // 8) % 3 END AS pay,"
    " CASE WHEN event_id % 13 > 0 THEN {text} END AS sig, event_id % 3 > 0 AS whole, event_id % 5 = 0 AS stable, (event_id // 16) % 5 AS episode FROM {events}"
)
VIEWS = _VIEWS.format(text="((event_id // 8) % 3)::VARCHAR", events="events")


def views(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, _VIEWS.format(text="CAST((event_id // 8) % 3 AS STRING)", events="{events}"))


_END = f"(SELECT max(ts_ms) - {LATENESS_MS} FROM ({VIEWS}))"
#: Each rig's readings with the next one's time; what falls due before that is due at its end.
_SPANS = f"SELECT *, coalesce(lead(ts_ms) OVER (PARTITION BY rig ORDER BY ts_ms, ord) - 1, {_END}) AS upto FROM ({VIEWS})"
_DUE = "CASE WHEN {first} <= {last} THEN ({last} - {first}) // {step} + 1 ELSE 0 END"
_LOOKS = walk(
    _SPANS,
    {"episode": "NULL::BIGINT", "armed": "NULL::BIGINT", "looked": "NULL::BIGINT", "words": "NULL::VARCHAR", "every": "2.5::DOUBLE", "beaten": "NULL::BIGINT",
     "burst1": "NULL::BIGINT", "bursts": "0::BIGINT", "beat1": "NULL::BIGINT", "beats": "0::BIGINT", "pace": "0::BIGINT"},
    [
        {"ended": "whole AND stable", "arms": "coalesce(pay > 0, false) AND episode IS DISTINCT FROM s_episode",
         "e": "CASE WHEN sig IS NULL THEN 2.5::DOUBLE WHEN s_words IS NOT DISTINCT FROM sig THEN least(12.0::DOUBLE, s_every * 1.6::DOUBLE) ELSE 2.5::DOUBLE END"},
        {"from_": "CASE WHEN ended THEN NULL WHEN arms THEN ts_ms ELSE s_armed END", "step_": "floor(e * 1000)::BIGINT + 1", "b0": "CASE WHEN sig IS NOT NULL AND s_words IS NOT NULL THEN s_beaten END"},
        {"d": "CASE WHEN from_ IS NOT NULL THEN greatest(from_, coalesce(s_looked + 501, from_)) END", "lim": "CASE WHEN from_ IS NOT NULL THEN least(upto, from_ + 3999) END", "bd": "CASE WHEN sig IS NOT NULL THEN greatest(ts_ms, coalesce(b0 + step_, ts_ms)) END"},
        {"k": f"coalesce({_DUE.format(first='d', last='lim', step='501')}, 0)", "bk": f"coalesce({_DUE.format(first='bd', last='upto', step='step_')}, 0)"},
    ],
    {"episode": "CASE WHEN ended THEN NULL WHEN arms THEN episode ELSE s_episode END", "armed": "from_", "looked": "CASE WHEN k > 0 THEN d + (k - 1) * 501 ELSE s_looked END", "words": "sig", "every": "e",
     "beaten": "CASE WHEN bk > 0 THEN bd + (bk - 1) * step_ ELSE b0 END", "burst1": "d", "bursts": "k", "beat1": "bd", "beats": "bk", "pace": "step_"},
    "rig, burst1, bursts, beat1, beats, pace",
)
ATTENTION_SQL = f"""SELECT rig, burst1 + 501 * unnest(generate_series(0, bursts - 1)) AS at_ms, 'burst' AS kind FROM ({_LOOKS}) WHERE bursts > 0
UNION ALL SELECT rig, beat1 + pace * unnest(generate_series(0, beats - 1)), 'beat' FROM ({_LOOKS}) WHERE beats > 0"""


@query(ATTENTION_SQL)
def looks(spark, sf_dir):
    rows = views(spark, sf_dir)
    return fold(rows, gates.Attention, until_ms=rows.agg(F.max("ts_ms")).first()[0] - LATENESS_MS)


@query(ATTENTION_SQL)
def stream_looks(spark, sf_dir):
    return streamed(spark, views(spark, sf_dir), gates.Attention, "looks")


@query(ORACLES["health_windows"])
def stream_health(spark, sf_dir):
    """Each read's window told as it comes, over micro-batches."""
    rows = reports.health_reads(report_plans.health_reads(spark, sf_dir))
    return reports.told_health(streamed(spark, rows, reports.HealthClock, "health"))


@query(ORACLES["error_log"])
def stream_error_log(spark, sf_dir):
    rows = _timed(frame_plans.diffs(spark, sf_dir)).select("rig", "ord", "ts_ms", F.col("sig").cast("string").alias("message"))
    return streamed(spark, rows, gates.ErrorLog, "errors").select("rig", "ord")
