import hashlib
import re
from collections import Counter, defaultdict

from offerloom.llm import mixing

from .helpers import awkward, docs

MANY = [(i, " ".join(["w"] * (1 + i * 37 % 90)), "en", None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", 0) for i in range(900)]


def brute(rows):
    d = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(("mix" + ("" if i is None else str(i))).encode()).hexdigest()) for i, t, _, s, _ in rows]
    size = Counter()
    for _, s, n, _ in d:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else weight[s] * share
            left -= target[s]
        open_ -= full or open_
    flows, copies = defaultdict(int), []
    for i, s, n, h in sorted(d, key=lambda x: (order.index(x[1]), x[3], -1 if x[0] is None else x[0], x[2])):
        flows[s] += n
        copies += [((flows[s] + c * size[s]) / weight[s], order.index(s), h, -1 if i is None else i, n, c, s) for c in range(2)]
    spent, taken = 0, Counter()
    for t in sorted(copies):
        spent += t[4]
        taken[t[3], t[6], t[4]] += t[4] if spent <= 1.5 * sum(size.values()) else 0
    return size, target, taken


def test_equals_one_global_queue(spark):
    for rows in (awkward(), MANY):
        found = mixing.mix_report(docs(spark, rows)).collect()
        sources = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, _, s, _ in rows}
        size, target, taken = brute(rows)
        got = Counter()
        for r in found:
            s = sources[r.doc_id, r["size"]]
            assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
            got[-1 if r.doc_id is None else r.doc_id, s, r["size"]] += r.taken
        assert len(found) == len(rows) and got == taken
    assert mixing.mix_report(docs(spark, [])).count() == 0


def test_mixed_rows_come_in_order_and_as_often_as_taken(spark):
    d = docs(spark, MANY)
    report = {r.doc_id: r for r in mixing.mix_report(d.repartition(5)).collect()}
    rows = mixing.mix(d).collect()
    assert set(rows[0].asDict()) == set(d.columns) and rows[0].copy == 7
    times = Counter(r.doc_id for r in rows)
    assert all(times[i] * r["size"] == r.taken for i, r in report.items())
    got = Counter(r.source for r in rows[: len(rows) // 4] for _ in range(len(r.text.split())))
    assert max(got["hot"], got[None]) and mixing.mix(docs(spark, [])).count() == 0
