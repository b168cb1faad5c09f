import random

from pyspark.sql import functions as F

from offerloom.operators import journal, sync
from offerloom.sources import journal_lines as jl

READING = "rig long, id string, seq int, ord long, seen_ms long, pay double, minutes double, miles double, whole boolean, suspect boolean, accepted boolean, hidden boolean"


def reading(i, ord_, pay, minutes=10.0, miles=2.0, whole=None, suspect=False, hidden=None):
    return (0, i, ord_, ord_, 1000 + ord_, pay, minutes, miles, whole, suspect, None, hidden)


def test_vote(spark):
    rows = [
        reading("a", 1, 7.5), reading("a", 2, 75.0), reading("a", 3, 7.5),  # two against one, the later of the two
        reading("b", 4, 7.5), reading("b", 5, 8.0),  # a tie goes to the later
        reading("c", 6, 7.5, whole=False), reading("c", 7, 7.5, whole=False), reading("c", 8, 9.0, minutes=11.0),
        reading("d", 9, 700.0, suspect=True), reading("d", 10, 700.0, suspect=True), reading("d", 11, 7.0, whole=False),
        reading("e", 12, 7.0), reading("e", 13, 7.0, miles=None),
        reading("f", 14, None, None, None), reading("f", 15, None, None, None), reading("f", 16, 5.0, 6.0, None),
    ]
    best = {r.id: r.ord for r in journal.vote(spark.createDataFrame(rows, READING)).collect()}
    assert best == {"a": 3, "b": 5, "c": 8, "d": 11, "e": 12, "f": 15}


def test_marks_and_rules(spark):
    rows = spark.createDataFrame([reading("a", 1, 7.5, miles=None), reading("b", 2, 7.5), reading("c", 3, 8.0)], READING)
    rules = spark.createDataFrame([(1, 7.5, 10.0, None, True), (2, 7.5, 10.0, 2.0, True), (3, 7.5, 10.0, 2.0, False), (4, 7.5, 10.0, 2.0, None), (5, 8.0, 10.0, 2.0, True)], "ord long, pay double, minutes double, miles double, hidden boolean").withColumn("rig", F.lit(0).cast("long"))
    marks = spark.createDataFrame([("c", 1, True, False), ("c", 2, None, None), ("b", 3, True, None), (None, 4, True, True)], "id string, ord long, accepted boolean, hidden boolean").withColumn("rig", F.lit(0).cast("long"))
    got = {r.id: (r.hidden, r.accepted) for r in journal.latest(rows, marks, rules).collect()}
    assert got == {"a": (True, None), "b": (False, True), "c": (False, True)}
    other = journal.latest(rows, marks.withColumn("rig", F.lit(1)), rules.withColumn("rig", F.lit(1)))
    assert {r.id: (r.hidden, r.accepted) for r in other.collect()} == {"a": (None, None), "b": (None, None), "c": (None, None)}


def test_window_tail_counts(spark):
    rows = journal.latest(spark.createDataFrame([reading(str(i), i, 5.0 + i, hidden=i % 4 == 0) for i in range(10)], READING), *(spark.createDataFrame([], s) for s in ("rig long, id string, ord long, accepted boolean, hidden boolean", "rig long, ord long, pay double, minutes double, miles double, hidden boolean")))
    inside = journal.window(rows, F.lit(1003))
    assert journal.hidden_counts(inside, ["rig"]).first()[1:] == (7, 2, 5)
    assert sorted(r.ord for r in journal.tail(journal.visible(inside), 3).collect()) == [6, 7, 9] and journal.tail(inside, 0).count() == 7


def test_rounding_is_exact(spark):
    values = [2.675, 0.125, 0.375, -2.5, 1.005, None, 1e300, 10.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2):
        assert [r[0] for r in df.select(journal.python_round(F.col("v"), places)).collect()] == [None if v is None else round(v, places) for v in values]


def test_requests(spark):
    bodies = ["[]", "7", '{"accepted": true}', '{"id": ""}', '{"id": "a", "accepted": 1}', '{"id": "a", "hidden": false}', '{"id": 3, "match": {"pay": 7, "minutes": 20}, "hidden": true}', '{"match": [], "hidden": true}', '{"match": {"pay": 7, "minutes": null}, "hidden": true}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", journal.note_of(F.try_parse_json("b")).alias("n")).orderBy("i").collect()
    assert [r.n.error for r in rows] == ["bad body", "bad body", "no offer named", "no offer named", "nothing to note", None, None, "a rule needs a pay and a time", "a rule needs a pay and a time"]
    assert (rows[5].n.kind, rows[6].n.kind, rows[6].n.pay, rows[6].n.miles) == ("mark", "rule", 7.0, None)


def test_lines_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None, ["x", "y"]), ("b", 2, 7.5, [])], "id string, seq int, pay double, places array<string>")
    jl.write_lines(rows, str(tmp_path / "j"))
    jl.write_lines(rows.limit(1), str(tmp_path / "j"))
    good = jl.good_rows(jl.parse_lines(jl.read_lines(spark, str(tmp_path / "j"))))
    assert sorted(r[0] for r in good.select(jl.field(F.col("row"), "id", "string")).collect()) == ["a", "a", "b"]


def test_csv_cells(spark):
    df = spark.createDataFrame([(1, 2.0, None, True, ["a", 'b "c"'], 'say "hi"', 9e18), (2, 2.5, "x", None, None, None, 0.0)], "a long, b double, c string, d boolean, e array<string>, g string, far double").withColumn("seen_ms", F.col("far").cast("long"))
    lines = [r.line for r in journal.csv_lines(df, ["a", "b", "c", "d", "e", "g"]).orderBy("a").collect()]
    assert lines == ['1,2,,1,"a; b ""c""","say ""hi""",""', '2,2.5,"x",,,,"1970-01-01T00:00:00.000Z"']


def test_damaged_lines(spark, tmp_path):
    raw = ['{"id":"a","seq":1,"pay":5}', "", "  ", '{"id":"a","se', "[1]", "3", "null", "NaN", '{"kind":"mark","at":1}', '{"id":"a/1","seq":2}', '{"id":"a","seq":"1/2"}', '{"id":1,"seq":1}', '{"id":"1","seq":1}', '{"id":1.0,"seq":1e0}', '{"kind":"new","id":"z","seq":1}', '{"id":null,"seq":1}']
    (tmp_path / "journal.jsonl").write_text("\n".join(raw) + "\n")
    parsed = jl.parse_lines(jl.read_lines(spark, str(tmp_path)))
    assert jl.bad_rows(parsed).count() == 5
    good = jl.good_rows(parsed).withColumn("key", jl.sync_key(F.col("row"))).orderBy("ord").collect()
    keys = [r.key for r in good]
    assert keys == ['["o","a",1.0]', None, '["o","a/1",2.0]', '["o","a","1/2"]', '["o",1.0,1.0]', '["o","1",1.0]', '["o",1.0,1.0]', '["knew","z",1.0]', None]


def test_ingest_twice_is_once(spark):
    batch = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4), (5, "c", 5)], "ord long, sync_key string, v int")
    have = spark.createDataFrame([(0, "c", 0)], "ord long, sync_key string, v int")
    new = sync.fresh(batch, have)
    assert sorted((r.sync_key, r.v) for r in new.collect()) == [("a", 1), ("b", 3)]
    assert sync.ingest_counts(batch, have).first().asDict() == {"added": 2, "duplicates": 2, "malformed": 1}
    assert sync.fresh(batch, have.unionByName(new.select("ord", "sync_key", "v"))).count() == 0


def test_sync_floor(spark):
    mine = spark.createDataFrame([(r, i, i * 1_000_000) for r in range(3) for i in range(10)], "rig long, ord long, seen_ms long")
    far = mine.where("rig = 0 AND ord < 8 OR rig = 1 AND ord IN (0, 7)")
    floors = {r.rig: r.floor_ms for r in sync.floor_of(mine, far, ["rig"], F.lit(5_000_000_000)).collect()}
    assert floors == {0: 7_000_000 - sync.OVERLAP_MS, 1: 0, 2: 5_000_000_000 - sync.FIRST_MS}


def plain(v):
    """A number as a script writes it: shortest digits, exponents only from 1e21 on and below 1e-6."""
    if v == 0:
        return "0"
    digits, _, e = repr(abs(v)).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(e or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len(figures)
    figures = figures.rstrip("0")
    if 1e-6 <= abs(v) < 1e21:
        said = figures[:point].ljust(point, "0") + "." + figures[point:] if point > 0 else "0." + "0" * -point + figures
        said = said.rstrip(".")
    else:
        said = figures[0] + ("." + figures[1:] if figures[1:] else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return ("-" if v < 0 else "") + said


def test_numbers_in_plain_digits(spark):
    r = random.Random(5)
    values = [12345678.9, 0.0005, 1e-6, 9.9e-7, 5e-7, 1e20, 1e21, 1.5e22, 0.1, -0.25, 3.0, -0.0, 100.0, 1e15, 123456789012345.6, 2.0**53, 0.30000000000000004, 1234567.125]
    values += [r.choice([-1, 1]) * r.random() * 10 ** r.randint(-9, 23) for _ in range(400)] + [round(r.uniform(-999, 999), r.randint(0, 4)) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    told = [r.t for r in df.select(journal.plain_number(F.col("v")).alias("t")).collect()]
    assert told == [plain(v) for v in values]


def test_rounding_near_halves(spark):
    r = random.Random(6)
    values = [2.675, 1.005, 0.125, 2.5, 1e300, -1e300, float("inf"), None, 1e-300, 12345.675, -2.675, 4503599627370497.5] + [round(r.uniform(-50, 50), 3) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    told = [r[0] for r in df.select(journal.python_round(F.col("v"), 2)).collect()]
    assert told == [None if v is None else round(v, 2) for v in values]


def test_figures_share_a_worker(spark, sf_dir, capsys):
    """Each rounded figure had a Python worker of its own in every task."""
    from offerloom.plans import record_plans

    capsys.readouterr()
    for rows in (journal.journal_rows, journal.live_rows):
        rows(record_plans.readings(spark, sf_dir)).explain()
        assert capsys.readouterr().out.count("ArrowEvalPython") == 1
