import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from offerloom.plans import control_plans, frame_plans, record_plans
from offerloom.streaming import controllers as c
from offerloom.streaming import gates
from offerloom.streaming.machines import LATENESS_MS, PROVIDER, fold, live, state_schema

FIRST = [400.0, 200.0, 1100.0, 200.0, 1100.0, 1700.0, 400.0, 1700.0]
W, H = 1536.0, 2048.0


def box(x, y, w=700.0, h=1500.0):
    return [x, y, x + w, y, x + w, y + h, x, y + h]


def tracker(quads, every=500, m=None, start=0):
    if m is None:
        m = c.ScreenTracker()
        m.begin({"quad": FIRST})
    out = []
    for i, q in enumerate(quads):
        q, reset = (None, True) if q == "reset" else (q, False)
        out += m.take({"ord": i, "ts_ms": start + i * every, "quad": q, "frame_width": W, "frame_height": H, "reset": reset})
    return m, out


def verdicts(quads, **how):
    return [r["verdict"] for r in tracker(quads, **how)[1]]


def test_tracker_nudges_at_once_and_settles():
    m, out = tracker([box(430, 200)] * 20)
    assert {r["verdict"] for r in out} == {"eased"} and abs(m.corners.now[0] - 430) < 1
    assert m.corners.calibrated == FIRST and (m.counts.moves, m.counts.jumps) == (20, 0)


def test_tracker_waits_for_agreement():
    assert verdicts([box(550, 200)] * 6) == ["waits"] * 4 + ["eased"] * 2
    # away from the corners and off the centre: taken whole by the fifth
    m, out = tracker([box(820, 300)] * 6)
    assert [r["verdict"] for r in out] == ["waits"] * 4 + ["adopted"] + ["eased"] and m.corners.now == box(820, 300)
    assert [r["disputing"] for r in out] == [True] * 4 + [False] * 2  # patience is over after two seconds
    # candidates that don't hold still never agree
    assert set(verdicts([box(820 if i % 2 else 1000, 300) for i in range(12)])) == {"waits"}


def test_tracker_takes_the_centre_after_two():
    m, _ = tracker([box(820, 300)] * 5)
    m, out = tracker([box(400, 200), box(400, 200)], m=m, start=10_000)
    assert [r["verdict"] for r in out] == ["waits", "centred"] and m.corners.calibrated == box(400, 200) and m.counts.centred == 1


def test_tracker_refuses_other_sizes_and_shapes():
    assert set(verdicts([box(500, 400, 500, 1070)] * 10)) == {"refused"}
    assert set(verdicts([box(100, 1700, 1340, 230)] * 80)) == {"refused"}  # a strip is never adopted
    # what was refused leaves no evidence behind
    quads = [box(500, 400, 500, 1070)] * 9 + [box(550, 200)]
    assert verdicts(quads)[-1] == "waits"
    # a walk downhill never runs the clock
    steps = [box(400 + 8 * i, 200 + 16 * i, 700 * 0.93**i, 1500 * 0.93**i) for i in range(1, 90)]
    assert "stalled" not in verdicts(steps)


def test_tracker_gives_its_calibration_up_after_half_a_minute():
    small = box(505, 425, 490, 1050)
    m, out = tracker([small] * 62)
    said = [r["verdict"] for r in out]
    assert said[:60] == ["refused"] * 60 and said[60] == "stalled" and m.corners.calibrated == small and m.counts.rebaselines == 1
    assert [r["stalled"] for r in out][:11] == [False] * 10 + [True] and not out[61]["stalled"]
    # another shape in between is no word on it
    mixed = [small if i % 2 else box(100, 1700, 1340, 230) for i in range(64)]
    assert verdicts(mixed)[61] == "stalled"


def test_tracker_misses_early_checks_and_resets():
    m, out = tracker([None, None, None, box(400, 200)])
    assert [r["lost"] for r in out] == [False, False, True, False] and out[3]["misses"] == 0
    assert verdicts([box(430, 200)] * 4, every=200) == ["eased", "early", "eased", "early"]
    m, out = tracker([box(820, 300)] * 5 + ["reset"])
    assert m.corners.now == FIRST and out[-1]["agreeing"] == 0 and m.counts.resets == 1 and not out[-1]["moved"]
    fresh = c.ScreenTracker()
    assert [r["verdict"] for r in tracker([box(1, 2), box(1, 2)], m=fresh)[1]] == ["calibrated", "eased"]


def gain(rows, every=6000, exposure=16667):
    m, out = c.AutoGain(), []
    m.begin({"gain": None, "exposure": exposure})
    for i, (bright, clipped, seen) in enumerate(rows):
        out += m.take({"ord": i, "ts_ms": i * every, "bright": bright, "clipped": clipped, "has_screen": seen})
    return m, [r["rule"] for r in out]


def test_gain_rules():
    m, rules = gain([(100.0, 0.0, True)] * 12)
    assert rules[:9] == ["raised"] * 9 and rules[-1] == "kept" and m.light.gain == 8.0
    m, rules = gain([(250.0, 0.5, False)] * 10)  # blown out, tracked or not: gain to its floor, then the exposure
    assert rules == ["lowered"] * 3 + ["shortened"] * 4 + ["blown out"] * 3 and (m.light.gain, m.light.exposure, m.turns.shortened) == (1.0, 1042, 4)
    assert gain([(200.0, 0.0, True), (0.0, 0.0, True), (10.0, 0.0, True), (100.0, 0.0, False), (230.0, 0.0, True)])[1] == ["near enough", "no picture", "no screen", "no screen", "lowered"]
    assert gain([(100.0, 0.0, True)] * 3, every=3000)[1] == ["raised", "early", "raised"]
    # exposure is given back before darkness is a reason to hold, but not beyond what the picture bears
    m, rules = gain([(250.0, 0.5, True)] * 6 + [(10.0, 0.0, False), (10.0, 0.0, False)])
    assert rules[-2:] == ["given back", "no screen"] and m.light.exposure == 16667
    m, rules = gain([(250.0, 0.5, True)] * 4 + [(187.0, 0.0, True)])
    assert rules[-1] == "near enough" and m.light.exposure == 8333
    assert gain([(250.0, 0.5, True)] * 5, exposure=None)[1][-1] == "blown out"


def looks(rows, end):
    m, out = gates.Attention(), []
    for i, r in enumerate(rows):
        out += m.take({"ord": i, "pay": None, "sig": None, "whole": False, "stable": False, "episode": None} | r)
    return [(r["at_ms"], r["kind"]) for r in [*out, *m.until(end)]]


def test_looks_come_without_rows():
    card = {"pay": 9.0, "sig": "a", "episode": 2}
    found = looks([{"ts_ms": 1000, **card}], 30_000)
    assert [t for t, k in found if k == "burst"] == [1000 + 501 * i for i in range(8)]
    assert [t for t, k in found if k == "beat"][:3] == [1000, 3501, 6002]
    # whole and stable ends the burst; the beat slows down as readings say the same
    found = looks([{"ts_ms": 1000, **card}, {"ts_ms": 2000, **card, "whole": True, "stable": True}], 20_000)
    assert [t for t, k in found if k == "burst"] == [1000, 1501] and [t for t, k in found if k == "beat"] == [1000, 5001, 9002, 13003, 17004]
    # once for each card, and none without one
    again = looks([{"ts_ms": 1000, **card}, {"ts_ms": 9000, **card}, {"ts_ms": 9500}], 40_000)
    assert len([1 for _, k in again if k == "burst"]) == 8 and max(t for t, _ in again) <= 9500


def test_state_schemas():
    assert state_schema(c.Clocks) == "checked long, disputed long, off long, stuck long, stuck_on array<double>"


MACHINES = {
    "tracker": (c.ScreenTracker, control_plans.outlines, control_plans.screens),
    "gain": (c.AutoGain, control_plans.light, control_plans.measured),
    "looks": (gates.Attention, control_plans.views, None),
    "motion": (gates.MotionGate, lambda s, d: frame_plans.diffs(s, d).withColumnRenamed("seen_ms", "ts_ms"), None),
    "speak": (gates.SpeakOnce, lambda s, d: record_plans.gates(s, d).withColumnRenamed("seen_ms", "ts_ms"), None),
}


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_stream_with_a_restart_equals_the_table(spark, sf_dir, name):
    """The stream stops after some batches and goes on from its checkpoint."""
    machine, source, first = MACHINES[name]
    rows, initial = source(spark, sf_dir), first and first(spark, sf_dir)
    end = rows.agg(F.max("ts_ms")).first()[0] - LATENESS_MS
    want = sorted(map(str, fold(rows, machine, until_ms=end, initial=initial).collect()))
    at = tempfile.mkdtemp()
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    cuts = [None, *rows.approxQuantile("ts_ms", [0.2, 0.5, 0.8], 0.0), None]
    for low, high in zip(cuts[:-1], cuts[1:]):
        some = rows if low is None else rows.where(F.col("ts_ms") > low)
        (some if high is None else some.where(F.col("ts_ms") <= high)).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if low == cuts[1] or high is None:
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
            live(stream, machine, initial).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    assert sorted(map(str, spark.read.parquet(f"{at}/out").collect())) == want and len(want) > 100


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "rig long, ord long, ts_ms long, diff long")
    assert fold(rows, gates.MotionGate).count() == 0


def test_a_row_of_the_tracker_takes_few_calls():
    """Each distance was a call or three, more than a hundred for a row."""
    n = 0

    def count(frame, what, arg):
        nonlocal n
        n += what == "call"

    rows = [box(400 + i % 5, 200) if i % 50 < 25 else box(900, 300) for i in range(200)]
    sys.setprofile(count)
    try:
        tracker(rows)
    finally:
        sys.setprofile(None)
    assert n / len(rows) < 60


def test_outlines_are_measured_as_their_corners_are_apart():
    a, b = [3.0, 4.0, 110.5, 2.25, 107.0, 208.0, 1.5, 199.0], [0.0, 0.0, 101.0, 7.0, 99.0, 213.5, 6.0, 204.0]
    d = lambda p, i, q, j: ((p[2 * i] - q[2 * j]) ** 2 + (p[2 * i + 1] - q[2 * j + 1]) ** 2) ** 0.5
    assert c.apart(a, b) == pytest.approx(sum(d(a, i, b, i) for i in range(4)) / 4)
    assert c.span(a) == pytest.approx((d(a, 0, a, 2) + d(a, 1, a, 3)) / 2)
    assert c.aspect(a) == pytest.approx((d(a, 0, a, 3) + d(a, 1, a, 2)) / (d(a, 0, a, 1) + d(a, 3, a, 2)))


@pytest.mark.parametrize("name, used", [
    ("stream_aiming_gate", "good"), ("stream_agreement_lock", "sig"), ("stream_motion_gate", "diff"), ("stream_error_log", "message"), ("stream_speak_once", "pay minutes ready locked whole"),
])
def test_streams_carry_what_their_machine_reads(spark, sf_dir, monkeypatch, name, used):
    """A row carried all columns of its table into the stream's files, the shuffle and Python."""
    seen = []
    monkeypatch.setattr(control_plans, "streamed", lambda _, rows, *how: seen.append(rows) or rows)
    getattr(control_plans, name)(spark, sf_dir)
    assert set(seen[0].columns) == {"rig", "ord", "ts_ms", *used.split()}
