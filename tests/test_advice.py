import random

from pyspark.sql import functions as F

from offerloom.operators import advice

OFFER = "rig long, ord long, seen_ms long, pay double, minutes double, accepted boolean, hidden int, suspect int, whole int"
MINUTE = 60_000


def offers(spark, rows):
    """rows of (minute, pay, minutes, accepted)"""
    return spark.createDataFrame([(0, i, int(t * MINUTE), float(p), float(m), took, 0, 0, 1) for i, (t, p, m, took) in enumerate(rows)], OFFER)


def brute(rows, gap, target):
    runs, run = [], []
    for i, (t, p, m, took) in enumerate(rows):
        if run:
            bt, _, bm, btook = rows[i - 1]
            if t - (bt + (bm if btook else 0)) > gap:
                runs.append(run)
                run = []
        run.append((t, p, m))
    runs = [r for r in [*runs, run] if len(r) > 1 and r[-1][0] > r[0][0]]
    earned = spent = trips = 0
    for r in runs:
        busy = -1
        for t, p, m in r:
            if t >= busy and p / (m / 60) >= target:
                earned, trips, busy = earned + p, trips + 1, t + m
        spent += max(r[-1][0], busy) - r[0][0]
    return round(earned, 6), round(spent, 6), trips


def test_replay_equals_a_plain_loop(spark):
    r = random.Random(4)
    t, rows = 0, []
    for _ in range(300):
        t += r.choice([1, 3, 7, 20, 40])
        rows.append((t, r.randint(200, 3000) / 100, r.randint(5, 45), r.random() < 0.2))
    df = offers(spark, rows)
    got = {(x.threshold, x.target): (round(x.earned_cents / 100, 6), round(x.busy_ms / MINUTE, 6), x.trips) for x in advice.replay(advice.segment(advice.usable(df))).collect()}
    assert got == {(g, k): brute(rows, g, k) for g in advice.THRESHOLDS for k in range(61)}
    shuffled = advice.replay(advice.segment(advice.usable(df.orderBy(F.rand(3)))))
    assert {(x.threshold, x.target): x.trips for x in shuffled.collect()} == {k: v[2] for k, v in got.items()}


def test_a_long_trip_is_no_silence(spark):
    rows = [(0, 10, 90, True), (95, 10, 10, False), (100, 10, 10, False), (200, 10, 10, False)]
    runs = {r.run: r.offers for r in advice.runs(advice.segment(advice.usable(offers(spark, rows)), (30,))).collect()}
    assert runs == {0: 3}
    # only the offer just before counts, not an earlier one that lasts longer
    rows = [(0, 10, 90, True), (5, 10, 10, False), (60, 10, 10, False), (70, 10, 10, False)]
    assert sorted(r.offers for r in advice.runs(advice.segment(advice.usable(offers(spark, rows)), (30,))).collect()) == [2, 2]


def test_unusable_rows(spark):
    rows = [(0, 0, 1, 5.0, 10.0, None, 1, 0, 1), (0, 1, 2, 5.0, 10.0, None, 0, 1, 1), (0, 2, 3, 5.0, 10.0, None, 0, 0, 0), (0, 3, 4, None, 10.0, None, 0, 0, None), (0, 4, 5, float("nan"), 10.0, None, 0, 0, None), (0, 5, 6, 5.0, 0.0, None, 0, 0, None), (0, 6, 7, 5.0, 10.0, None, None, None, None)]
    df = spark.createDataFrame(rows, OFFER)
    assert [r.ord for r in advice.usable(advice.trustworthy(df)).collect()] == [6]
    assert advice.advise(df).first().reason == "trips" and advice.advise(df.limit(0)).count() == 0


def test_ready(spark):
    rows = [(14 * i, 18 if i % 3 == 1 else 5, 30, False) for i in range(120)]
    row = advice.advise(offers(spark, rows)).first()
    assert row.ready and row.reason is None and row.suggested == 11 and row.plateau_high == 36


def test_offers_are_sorted_once(spark, capsys):
    """Windows over each threshold's offers held them again and again; batches of any size go on from each other."""
    r, rows = random.Random(5), []
    for rig in range(3):
        t = 0
        for i in range(60):
            t += r.choice([1, 3, 20, 40])
            rows.append((rig, i, t * MINUTE, 9.0, 10.0, r.random() < 0.2, 0, 0, 1))
    df = advice.usable(spark.createDataFrame(rows, OFFER))
    capsys.readouterr()
    advice.segment(df).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and plan.count("Sort [") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(x.rig, x.threshold, x.ord): x.run for x in advice.segment(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for gap in advice.THRESHOLDS:
        before = None
        for rig, i, at, _, minutes, took, *_ in rows:
            run = 0 if before is None or before[0] != rig else run + (at - before[1] > gap * MINUTE)
            assert got[rig, gap, i] == run
            before = (rig, at + minutes * MINUTE * took)
