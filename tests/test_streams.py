import sys

import pyarrow as pa
import pytest

from offerloom.plans import stream_plans
from offerloom.streaming import jobs
from offerloom.streaming.machines import in_order, live, packs_of, plain
from offerloom.streaming.merge import Card, Offer, identify, merge, resumed, vote, winner


READING = "rig long, ord long, ts_ms long, pay double, minutes double, miles double, items double, deliver_by int, legs int, leg_detail array<struct<minutes:double,miles:double,is_total:boolean>>, miles_corrected boolean, shop boolean, settled boolean, locked boolean"


def event(ts, pay=10.0, legs=((20.0, 5.0, False),), **more):
    detail = [{"minutes": m, "miles": d, "is_total": t} for m, d, t in legs]
    far = [d for _, d, _ in legs if d is not None]
    return {"rig": 0, "ord": ts, "ts_ms": ts, "pay": pay, "minutes": sum(m for m, _, _ in legs) or None, "miles": sum(far) if far else None, "items": None, "deliver_by": None, "legs": len(legs), "leg_detail": detail, "miles_corrected": False, "shop": None, "settled": False, "locked": True} | more


def run(events):
    out, held = [], {}
    for e in events:
        m = jobs.Merging()
        m.unpack(held)  # as a state store hands it over
        out += m.step(e)
        held = m.pack()
    return out


def test_lost_legs_and_votes():
    two = ((4.0, 1.0, False), (18.0, 6.5, False))
    rows = run([event(0, legs=two), event(1000, legs=two[1:]), event(2000, legs=((4.0, 1.0, False), (18.0, 65.0, False))), event(3000, legs=two)])
    assert [r["minutes"] for r in rows] == [22, 22, 22, 22] and rows[1]["grew"] and rows[3]["miles"] == 7.5 and rows[3]["merged_from"] == 4
    votes = []
    for v in (3, 23, 3, None, 23):
        votes = vote(votes, v)
    assert winner(votes) == 23 and winner([]) == 0
    # a leg of no minutes is a leg; a card without any has none
    assert run([event(0, legs=((0.0, 1.0, False), (18.0, 6.5, False)))])[0]["legs"] == 2
    assert run([event(0, legs=(), legs_=0, minutes=9.0)])[0]["legs"] == 0


def test_windows_and_new_cards():
    rows = run([event(0), event(11_000), event(13_000), event(14_000, pay=11.0)])
    assert [r["episode"] for r in rows] == [2, 2, 3, 4] and [r["merged_from"] for r in rows] == [1, 2, 1, 1]
    other = event(4_000, legs=((35.0, 17.0, False),))
    rows = run([event(0), other])
    assert rows[1]["new_card"] and rows[1]["episode"] == 3
    soon = run([event(0), event(1_000, legs=((35.0, 17.0, False),))])
    assert not soon[1]["new_card"] and soon[1]["episode"] == 2
    blank = run([event(0), event(1_000, pay=None), event(2_000)])
    assert blank[1]["merged_from"] == 0 and blank[2]["merged_from"] == 2


def journal(events, state=None):
    card, state, out = Card(), state or Offer(), []
    for e in events:
        card, m = merge(card, e)
        state, row = identify(state, m)
        if row:
            out.append(row)
    return out


def test_identity():
    rows = journal([event(0), event(1000), event(2000, settled=True), event(3000, settled=True), event(20_000), event(200_000)])
    assert [(r["offer_id"], r["seq"], r["settled"]) for r in rows] == [("0-1000", 1, False), ("0-1000", 2, True), ("200000-1000", 1, False)]
    # an impossible pay between two readings of a card neither ends it nor anchors it
    rows = journal([event(0), event(5_000, pay=1000.0), event(9_000)])
    assert {r["offer_id"] for r in rows} == {"0-1000"} and [r["seq"] for r in rows] == [1, 2, 3]
    assert [r["offer_id"] for r in journal([event(0), event(5_000, pay=12.0)])] == ["0-1000", "5000-1200"]


def test_settled_once_more_for_each_content():
    rows = journal([event(0, settled=True), event(1000, settled=True), event(2000, settled=True), event(3000, items=2.0), event(4000, items=2.0, settled=True)])
    assert [(r["seq"], r["settled"]) for r in rows] == [(1, True), (2, True), (3, False), (4, True)]


def test_what_writes_a_row():
    """All that moves money or trust writes a row, and nothing else does."""
    base = event(0, legs=((20.0, 5.0, False),))
    flips = {
        "a total": (event(1000, legs=((20.0, 5.0, True),)), 2), "items": (event(1000, items=3.0), 2), "a deadline": (event(1000, deliver_by=900), 2),
        "a shop flag": (event(1000, shop=True), 1), "the same": (event(1000), 1), "a corrected distance": (event(1000, miles_corrected=True), 1),
        "a distance too far": (event(1000, legs=((20.0, 55.0, False),)), 2),
    }
    for what, (e, rows) in flips.items():
        assert len(journal([base, e])) == rows, what
    total = journal([base, event(1000, legs=((20.0, 5.0, True),))])[-1]
    assert total["has_total"] and total["minutes"] == 20 and total["seq"] == 2
    # a leg count alone says nothing new
    a, b = (m | {"episode": 2, "new_card": False} for m in (merge(Card(), base)[1], merge(Card(), base)[1]))
    offer, _ = identify(Offer(), a)
    assert identify(offer, b | {"legs": 2})[1] is None and identify(offer, b | {"miles_uncertain": True})[1]


def test_legs_without_a_time_leave_the_readings_own():
    assert merge(Card(), event(0, legs=((0.0, 1.0, False),), minutes=12.0))[1]["minutes"] == 12.0


def test_another_journey_at_equal_pay_is_another_offer():
    other = [event(4_000, legs=((35.0, 17.0, False),)), event(5_000, legs=((35.0, 17.0, False),))]
    assert [(r["offer_id"], r["seq"]) for r in journal([event(0), *other])] == [("0-1000", 1), ("4000-1000", 1)]
    # seen again after its window, or later than the first window: still the same offer
    assert [r["offer_id"] for r in journal([event(0), event(13_000), event(26_000, items=2.0)])] == ["0-1000", "0-1000"]


def test_unlocked_readings_write_nothing(spark):
    rows = spark.createDataFrame([{k: e[k] for k in jobs.EVENT} for e in (event(0, locked=False), event(1000), event(2000, locked=False, items=4.0), event(3000))], READING)
    assert [(r.ts_ms, r.seq, r["items"]) for r in jobs.merge_batch(rows, journal=True).orderBy("ts_ms").collect()] == [(1000, 1, None), (3000, 2, 4.0)]


def test_restart(spark):
    last = journal([event(0)])[-1]
    rows = spark.createDataFrame([{k: e[k] for k in jobs.EVENT} for e in (event(80_000), event(81_000, settled=True), event(400_000))], READING)
    written = spark.createDataFrame([{k: last[k] for k in ["rig", *jobs.LAST]}], "rig long, ts_ms long, offer_id string, seq int, first_ms long, pay double, minutes double, miles double, items double, deliver_by int, has_total boolean, miles_uncertain boolean")
    ids = lambda df: [(r.offer_id, r.seq, r.settled) for r in df.orderBy("ts_ms").collect()]
    assert ids(jobs.merge_batch(rows, journal=True, last=written)) == [("0-1000", 2, True), ("400000-1000", 1, False)]
    assert ids(jobs.merge_batch(rows, journal=True))[0] == ("80000-1000", 1, False)
    streamed = stream_plans.drain(spark, rows, lambda s: jobs.merge_stream(s, journal=True, last=written), "resume")
    assert ids(streamed) == [("0-1000", 2, True), ("400000-1000", 1, False)]
    assert journal([event(80_000)], resumed(last, 80_000)) == []
    assert journal([event(95_000)], resumed(last, 95_000))[0]["offer_id"] == "95000-1000"


@pytest.mark.parametrize("as_journal", [False, True])
def test_stream_equals_batch(spark, sf_dir, as_journal):
    events = stream_plans.events(spark, sf_dir)
    batch = jobs.merge_batch(events, journal=as_journal)
    stream = stream_plans.drain(spark, events, lambda s: jobs.merge_stream(s, journal=as_journal), "test")
    key = lambda r: str(sorted(r.asDict().items(), key=str))
    a, b = sorted(map(key, batch.collect())), sorted(map(key, stream.select(*batch.columns).collect()))
    assert a == b and len(a) > 500


def test_a_larger_table_has_more_batches(spark, tmp_path):
    """Batches grew with the table, and with them what a task holds."""
    rows = spark.range(1000).selectExpr("id AS ord", "(id * 7919) % 500 AS ts_ms")
    stream_plans.feed(spark, rows, str(tmp_path), 3, "ts_ms", 100)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    told = [[r.ts_ms for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert sum(map(len, told)) == 1000 and max(map(len, told)) <= 200 and len(told) == 10
    assert all(max(a) < min(b) for a, b in zip(told, told[1:]))


def test_rows_of_a_stream_travel_packed(spark, monkeypatch):
    """Each row of a stream was a row of Spark's own in Python, which costs more than what a machine does with it."""
    monkeypatch.setattr("offerloom.streaming.machines.PACK_ROWS", 30)
    shown = [{"rig": i % 3 if i % 7 else None, "ts_ms": (i * 7) % 11, "ord": i, "x": [{"a": i * 1.0}] * (i % 3)} for i in range(100)]
    packs = list(packs_of((b for b in pa.Table.from_pylist(shown).to_batches(10)), "rig"))
    assert len(packs) == 16  # of four keys each time
    for key in (None, 0, 1, 2):
        told = list(in_order(p for k, p in packs if k == key))
        assert told == sorted((r for r in shown if r["rig"] == key), key=lambda r: (r["ts_ms"], r["ord"]))
    assert list(packs_of([], "rig")) == []
    rows = spark.readStream.schema("rig long, ord long, ts_ms long, chunk string").parquet("/root/testdata")
    from offerloom.streaming import gates, ingest

    seen = lambda s, machine: live(s, machine)._jdf.queryExecution().analyzed().toString()
    assert "_rows" in seen(rows, ingest.Framing)
    assert "_rows" not in seen(rows, gates.Attention)  # it is told of each row by the watermark whether it is late


@pytest.mark.parametrize("values", [[1, None, 3], [1.5, float("inf"), None], [True, None, False], ["a", None, ""], [[1.0], None, [], [2.0, None]], [{"a": 1, "b": [None]}, {"a": None, "b": None}], [{"a": 1}, None], [[{"a": "x"}], None], []])
def test_plain_values(values):
    column = pa.array(values)
    assert plain(column) == values and plain(column.slice(1)) == values[1:]
    assert all(type(a) is type(b) for a, b in zip(plain(column), values))


def test_states_are_kept_by_as_many_tasks_as_keys_take(spark, tmp_path, monkeypatch):
    """A stream over four rigs opened and committed a store for every task of a shuffle, in every micro-batch."""
    from offerloom.streaming import gates

    monkeypatch.setattr(stream_plans, "_folder", lambda _: str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(24).selectExpr("id % 4 AS rig", "id AS ord", "id AS ts_ms", "id % 8 > 0 AS good")
        told = stream_plans.drain(spark, rows, lambda s: live(s, gates.Aim), "few")
        assert sorted((r.ord, r.aimed) for r in told.collect()) == [(i, i in (21, 22, 23)) for i in range(24)]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        kept = [x.name for x in (tmp_path / "state" / "state" / "0").iterdir() if x.name.isdigit()]
        assert 4 <= len(kept) < 10
        assert stream_plans.state_tasks(spark.range(2000).withColumnRenamed("id", "rig"), 40) == 40
        assert stream_plans.state_tasks(spark.range(0).withColumnRenamed("id", "rig"), 40) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("machine, most", [(jobs.Merging, 34), (jobs.Journal, 42)])
def test_a_reading_takes_few_calls(machine, most):
    """Cards and offers were copied by ``replace``, votes and legs asked in generators."""
    n = 0

    def count(frame, what, arg):
        nonlocal n
        n += what == "call"

    two = ((4.0, 1.0, False), (18.0, 6.5, False))
    events, m = [event(i * 1000, pay=10.0 + i // 9, legs=two if i % 3 else two[1:]) for i in range(300)], machine()
    sys.setprofile(count)
    try:
        for e in events:
            for _ in m.take(e):
                pass
    finally:
        sys.setprofile(None)
    assert n / len(events) < most, n / len(events)
