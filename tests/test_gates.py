from pyspark.sql import functions as F

from offerloom.functions import geometry, rating
from offerloom.operators import frames, reports


def test_spoken_and_ago(spark):
    said = spark.createDataFrame([("go", 24.5, None), ("warn", 25.5, None), ("no", 3.2, None), ("doubt", 3500.0, "pay"), ("doubt", 1.0, "time"), ("doubt", 1.0, "speed"), ("doubt", 1.0, None), ("empty", None, None)], "s string, p double, d string")
    got = [r[0] for r in said.select(reports.spoken(F.col("s"), F.col("p"), F.col("d"))).collect()]
    assert got == ["accept. 24 an hour.", "close. 26 an hour.", "pass. 3 an hour.", "check the pay.", "check the time.", "check the distance.", "read that again.", None]
    ages = [0, 29_999, 30_000, 90_000, 59 * 60_000 + 29_999, 3_570_000, 89 * 60_000, 90 * 60_000, 23 * 3_600_000 + 29 * 60_000, 23 * 3_600_000 + 30 * 60_000, 36 * 3_600_000]
    got = [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a long").orderBy("i").select(reports.ago(F.col("a"))).collect()]
    assert got == ["now", "now", "1m ago", "2m ago", "59m ago", "1h ago", "1h ago", "2h ago", "23h ago", "1d ago", "2d ago"]


def test_money(spark):
    x = spark.createDataFrame([(i, v) for i, v in enumerate([None, float("nan"), float("inf"), -3.14159, 99.9, 100.4, -250.0])], "i int, v double").orderBy("i")
    got = x.select(reports.money_text(F.col("v")).alias("m"), reports.rate_text(F.col("v")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("--", "--"), ("--", "--"), ("--", "--"), ("-$3.14", "-$3.1"), ("$99.90", "$99.9"), ("$100.40", "$100"), ("-$250.00", "-$250")]


def test_typed(spark):
    texts = ["12.5", " 7 min", ".5", "-3", "x", "", None, "1e2"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(rating.typed(F.col("t"))).collect()
    assert [r[0] for r in got] == [12.5, 7.0, 0.5, -3.0, 0.0, 0.0, 0.0, 100.0]
    clock = spark.sql("SELECT timestamp'2024-06-01 10:00:00' AS a UNION ALL SELECT timestamp'2025-06-01 10:30:00'").select(rating.clock_minutes(F.col("a")).alias("m")).collect()
    assert [r.m for r in clock] == [None, 630]


def test_health_windows(spark):
    times = [0, 60_000, 119_999, 120_000, 239_999, 240_000, 1_000_000, 1_119_999, 1_120_000]
    reads = spark.createDataFrame([(0, t, float(i), i % 2 == 0, None, False) for i, t in enumerate(times)], "rig long, seen_ms long, ms double, complete boolean, pay double, failed boolean")
    got = [(r.from_ms, r.reads, r.no_pay, r.upper_median_ms) for r in reports.health(reads).orderBy("from_ms").collect()]
    assert got == [(0, 3, 3, 1.0), (120_000, 2, 2, 4.0), (240_000, 1, 1, 5.0), (1_000_000, 2, 2, 7.0), (1_120_000, 1, 1, 8.0)]


def test_tsv(spark):
    lines = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", "5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t96.1\t $7.50 ", "4\t1\t1\t1\t1\t0\t10\t20\t30\t40\t-1\t", "5\t1\t1\t1\t1\t2\tx\t20\t30\t40\t96\tw", "5\t1\t1"]
    got = frames.tsv_words(spark.createDataFrame([(0, x) for x in lines], "page int, line string")).collect()
    assert [(r.text, r.left, r.conf) for r in got] == [("$7.50", 10, 96.1)]


def test_quads(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    q = F.array(p(0, 0), p(10, 2), p(12, 20), p(-1, 18))
    row = spark.range(1).select(*(geometry.contains(q, p(*xy)) for xy in ((5, 5), (0, 0), (11, 0), (-2, 9))), geometry.same_shape(q, q), geometry.near(q, q, 0.0)).first()
    assert tuple(row) == (True, True, False, False, True, True)


def test_a_page_sorts_its_readings_once(spark, sf_dir, capsys):
    """Windows within windows sorted and held a rig's readings again and again."""
    from offerloom.plans import record_plans

    capsys.readouterr()
    record_plans.browser_lock(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and plan.count("Sort [") == 1
