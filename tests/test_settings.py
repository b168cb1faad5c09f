import tempfile

from pyspark.sql import functions as F

from offerloom.sources import journal_lines as jl
from offerloom.sources import settings


def test_settings_keep_their_types(spark):
    texts = ['{"target":32,"speak":true,"name":"x"}', '{"target":"32","speak":"true","name":5}', "torn{", "[1]", None, "", "null", '{"target":0,"name":""}', '{"a":{"target":3}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    told = [tuple(r.s) for r in df.select("i", settings.typed_settings(F.col("t"), {"target": 25.0, "speak": False, "name": "rig"}).alias("s")).orderBy("i").collect()]
    none = (25.0, False, "rig")
    assert told == [(32.0, True, "x"), none, none, none, none, none, none, (0.0, False, ""), none]


def test_drafts_go_after_three_minutes(spark):
    texts = ['{"t":1000,"entry":{"pay":"9"},"active":"pay"}', '{"t":999,"entry":{"pay":"9"}}', '{"t":200000,"entry":{"pay":9,"miles":"2"},"active":"fuel"}', '{"t":200000}', '{"entry":{}}', '{"t":200000,"entry":[]}', "torn{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, draft string")
    told = {r.i: (r.entry.pay, r.entry.miles, r.active) for r in settings.fresh_drafts(df, F.lit(181_000), ("pay", "miles")).collect()}
    assert told == {0: ("9", None, "pay"), 2: (None, "2", None)}


def test_restarts_wait_longer_until_a_healthy_run(spark):
    ran = [0, 0, 0, 0, 0, 0, 60_000, 60_001, 5, 5]
    df = spark.createDataFrame([(1, i, i, r) for i, r in enumerate(ran)], "rig long, ord long, seen_ms long, ran_ms long")
    told = [r.wait_ms for r in settings.restart_waits(df, ["rig"]).orderBy("ord").collect()]
    assert told == [3000, 6000, 12000, 24000, 48000, 48000, 48000, 3000, 6000, 12000]


def test_tail_and_append(spark):
    df = spark.createDataFrame([(1, 0, 1.5), (1, 1, None), (2, 5, 2.0)], "rig long, ord long, pay double")
    assert sorted(map(tuple, settings.tail(df, ["rig"], 1).collect())) == [(1, 1, None), (2, 5, 2.0)] and settings.tail(df, ["rig"], 0).count() == 3
    path = f"{tempfile.mkdtemp()}/j"
    for batch in (0, 0, 1):
        jl.append_batch(df, path, batch)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == 6 and sorted(set(lines)) == ['{"ord":0,"pay":1.5,"rig":1}', '{"ord":1,"pay":null,"rig":1}', '{"ord":5,"pay":2.0,"rig":2}']
