import zlib
from collections import Counter, defaultdict

from offerloom.llm import sharding

from .helpers import awkward, docs


def test_law_slots_and_sizes(spark):
    for rows in (awkward(), [(i, "t", "en", "s", 1) for i in range(1000)]):
        found = sharding.shard_report(docs(spark, rows)).collect()
        counts = Counter(r.shard for r in found)
        assert len(found) == len(rows) and max(counts.values()) - min([counts.get(s, 0) for s in range(24)]) <= 1
        slots = defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    assert sharding.shard_report(docs(spark, [])).count() == 0


def test_slack_limits_movement():
    nodes = sharding.ring(24)
    counts = {i: 10 + i % 7 for i in range(len(nodes))}
    total = sum(counts.values())
    own = lambda places: sum(n for arc, _, n, shard, _ in places if shard == nodes[arc][1])
    tight, loose = (own(sharding.fill(counts, nodes, sharding.bounds(total, 24, s))) for s in (0.0, 0.25))
    assert total * 0.7 < tight < loose <= total
    placed = sharding.fill(counts, nodes, sharding.bounds(total, 24))
    assert sum(n for _, _, n, _, _ in placed) == total


def test_same_plan_whatever_the_partitions(spark):
    d = docs(spark)
    a, b = (sorted(map(str, sharding.shard_report(x).collect())) for x in (d, d.repartition(9)))
    assert a == b


def test_no_python(spark):
    plan = sharding.shard_report(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def walk(rows, shards=24):
    """Key by key: each row to the shard of the next point clockwise while there is room; what is left of each arc, in the
    order of the arcs and of positions, goes on clockwise."""
    import hashlib
    from bisect import bisect_left

    place = lambda key: int(hashlib.md5(key.encode()).hexdigest()[:8], 16)
    nodes = sorted((place(f"shard {s} point {p}"), s) for s in range(shards) for p in range(sharding.POINTS))
    ahead = [p for p, _ in nodes]
    arcs = defaultdict(list)
    for i, t, *_ in rows:
        body = (t or "").encode()
        at = place("" if i is None else str(i))
        k = bisect_left(ahead, at) % len(nodes)
        arcs[k].append(((at - nodes[k - 1][0] - 1) % (1 << 32), i is not None, i or 0, zlib.crc32(body), len(body) + 8))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    slots, out, rest = [0] * shards, [], []

    def put(row, s):
        out.append((row[2] if row[1] else None, row[4], row[3], s, slots[s]))
        slots[s] += 1
        room[s] -= 1

    for k in range(len(nodes)):
        for row in sorted(arcs[k]):
            if room[nodes[k][1]]:
                put(row, nodes[k][1])
            else:
                rest.append((k, row))
    for k, row in rest:
        put(row, next(nodes[(k + j) % len(nodes)][1] for j in range(1, len(nodes) + 1) if room[nodes[(k + j) % len(nodes)][1]]))
    return out


def test_placement_equals_a_walk_key_by_key(spark):
    for rows in (awkward(), [(i * 7, "t" * (i % 9), "en", "s", 1) for i in range(1500)]):
        found = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard_report(docs(spark, rows)).collect()]
        assert sorted(map(str, found)) == sorted(map(str, walk(rows)))
