import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from offerloom.plans import ingest_plans
from offerloom.streaming import ingest
from offerloom.streaming.machines import fold


def framed(pieces):
    m, out = ingest.Framing(), []
    for i, p in enumerate(pieces):
        out += m.step({"ord": i, "ts_ms": i, "chunk": p})
    return [r["line"] for r in out], m.tail.text


def test_framing_keeps_the_partial_line():
    assert framed(["ab", "c\nd", "\n \n", None, "e\r\nf"]) == (["abc", "d", "e"], "f")
    assert framed([]) == ([], "") and framed(["\n\n"]) == ([], "")


def test_routes(spark):
    lines = ['{"phase":"aim"}', '{"ready":true}', "[1]", "starting", '{"torn"', "null", "{}"]
    df = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(lines)], ingest.LINE)
    told = {r.line: (r.route, r.phase, r.ready) for r in ingest.routed(df).collect()}
    assert {x for x, (route, *_) in told.items() if route == "journal"} == {'{"phase":"aim"}', '{"ready":true}', "{}"}
    assert told['{"phase":"aim"}'][1] == "aim" and told['{"ready":true}'][2] is True


def run(writer, at):
    writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_the_first_row_of_a_key_stays_in_every_order_of_batches(spark, order):
    at = tempfile.mkdtemp()
    batches = [[(0, "a0", "a"), (1, "b1", "b"), (2, "a2", "a")], [(3, "b3", "b"), (4, "c4", "c"), (5, "none", None)], [(6, "c6", "c"), (7, "a7", "a"), (8, "d8", "d")]]
    want, came = {}, []
    for i in order:
        came += batches[i]
        for _, line, key in batches[i]:
            if key:
                want.setdefault(key, line)
        spark.createDataFrame(batches[i], ingest.KEYED).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(ingest.KEYED).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        run(ingest.ingest(stream, f"{at}/store", f"{at}/counts"), at)  # each time from its checkpoint
    assert {r.sync_key: r.line for r in ingest.stored(spark, f"{at}/store", ingest.KEYED).collect()} == want
    counts = spark.read.parquet(f"{at}/counts").agg(F.sum("rows"), F.sum("malformed"), F.sum("added")).first()
    assert tuple(counts) == (9, 1, 4)


def test_a_batch_run_again_leaves_the_same(spark):
    at = tempfile.mkdtemp()
    first = spark.createDataFrame([(0, "x", "a"), (1, "y", "b")], ingest.KEYED)
    for _ in range(2):
        ingest.write_batch(ingest.unseen(first, ingest.stored(spark, f"{at}/store", ingest.KEYED, 0)), f"{at}/store", 0)
    again = spark.createDataFrame([(2, "z", "b"), (3, "w", "c")], ingest.KEYED)
    for _ in range(2):
        ingest.write_batch(ingest.unseen(again, ingest.stored(spark, f"{at}/store", ingest.KEYED, 1)), f"{at}/store", 1)
    assert sorted(r.line for r in ingest.stored(spark, f"{at}/store", ingest.KEYED).collect()) == ["w", "x", "y"]


def test_keys_of_lines(spark):
    lines = spark.createDataFrame([(0, '{"id":"a","seq":1}'), (1, '{"id":"a","seq":1.0,"pay":3}'), (2, "{torn"), (3, '{"kind":"mark"}')], "ord long, line string")
    keys = [r.sync_key for r in ingest.with_key(lines).orderBy("ord").collect()]
    assert keys[0] == keys[1] is not None and keys[2:] == [None, None]


def test_bodies_over_the_cap_are_refused_unread_and_files_go(spark):
    at = tempfile.mkdtemp()
    os.makedirs(f"{at}/in")
    for name, body in {"small": b'{"a":1}\n\n  {"b":2}', "large": b"x" * 200, "bytes": b"\xff\xfe", "empty": b""}.items():
        with open(f"{at}/in/{name}", "wb") as f:
            f.write(body)
    told = lambda: ingest.bodies(spark, f"{at}/in", 100, 150).writeStream.format("parquet").option("path", f"{at}/out")
    run(told(), at)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.parquet(f"{at}/out").collect()}
    assert {k: r.reason for k, r in rows.items()} == {"small": None, "large": "body over 100 bytes", "bytes": "not text"}
    assert rows["large"].body is None and rows["large"].bytes == 200
    assert [(r.nth, r.line) for r in ingest.body_lines(spark.read.parquet(f"{at}/out")).orderBy("nth").collect()] == [(0, '{"a":1}'), (2, '{"b":2}')]
    with open(f"{at}/in/later", "wb") as f:
        f.write(b"{}")
    run(told(), at)
    until = time.time() + 20
    while "small" in os.listdir(f"{at}/in") and time.time() < until:
        time.sleep(0.5)
    assert "small" not in os.listdir(f"{at}/in")


def test_last_values_over_batches(spark):
    at = tempfile.mkdtemp()
    kind = "rig long, seen_ms long, ord long, v string"
    for rows in ([(1, 5, 0, "a"), (2, 1, 0, "b")], [(1, 4, 0, "late")], [(2, 9, 0, "c"), (3, 1, 0, "d")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{at}/in")
        run(ingest.last_values(spark.readStream.schema(kind).parquet(f"{at}/in"), f"{at}/last"), at)
    told = ingest.newest_values(spark, f"{at}/last", "rig long, `last` struct<seen_ms:bigint,ord:bigint,v:string>").select("rig", "last.v").collect()
    assert sorted(map(tuple, told)) == [(1, "a"), (2, "c"), (3, "d")]
    assert ingest.newest_values(spark, f"{at}/nothing", "rig long, `last` struct<v:string>").count() == 0


def test_objects_merge_by_key(spark):
    cases = [
        ('{"a":1,"b":{"x":[1,2]},"old":1}', '{"b":null,"c":"q\\"uote"}', {"a": 1, "b": None, "c": 'q"uote', "d": {"t": 2}}),
        (None, '{"d":5}', {"d": 5}), ("torn{", "[1]", {"d": {"t": 2}}), ('{"d":{"t":9}}', "{}", {"d": {"t": 9}}), ('{"ключ":1.5}', '{"old":3}', {"ключ": 1.5, "d": {"t": 2}}),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    told = df.select("i", ingest.merged_object(F.col("a"), F.col("b"), ("old",), F.lit('{"d":{"t":2}}')).alias("m")).orderBy("i").collect()
    assert [json.loads(r.m) for r in told] == [want for *_, want in cases]
    assert all(list(json.loads(r.m)) == sorted(json.loads(r.m)) for r in told)


def test_backups_write_only_changes(spark):
    bodies = ['{"quad":[1],"a":2}', '{ "a":2, "quad":[1] }', '{"a":1}', "torn{", '{"quad":[2]}', '{"quad":0}', '{"quad":[2]}', '{"quad":[1],"a":2}']
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "rig long, ord long, body string")
    none = spark.createDataFrame([], "rig long, digest string")
    told = ingest.backups(df, none).orderBy("ord").collect()
    assert [r.changed for r in told] == [True, False, False, False, True, False, False, True]
    assert [r.error for r in told] == [None, None, "not a calibration", "not a calibration", None, "not a calibration", None, None]


def test_pieces_over_a_table(spark):
    df = spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 0, "x\ny"), (1, 1, 5, "b\n"), (2, 1, 5, "z\n")], "rig long, ord long, ts_ms long, chunk string")
    assert sorted((r.rig, r.ord, r.line) for r in fold(df, ingest.Framing).collect()) == [(1, 0, "ab"), (2, 0, "x"), (2, 1, "yz")]


def test_batches_of_bodies_grow_with_what_is_sent():
    """Bodies of a table 60 times as large took 60 times as many micro-batches."""
    batches = lambda sent: -(-sent // ingest_plans.batch_bytes(sent))
    assert batches(7 << 20) <= 5 and batches(420 << 20) <= 8 and ingest_plans.batch_bytes(1 << 40) == 64 << 20 and ingest_plans.batch_bytes(None) == 128 << 10


def test_objects_are_read_once(spark, capsys):
    """Each key of the result read its objects again."""
    df = spark.range(1).select(F.col("id").cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    capsys.readouterr()
    df.select(ingest.merged_object(F.col("a"), F.col("b"), ("old",), F.lit('{"d":1}')).alias("m")).explain()
    assert capsys.readouterr().out.count("from_json") == 2
