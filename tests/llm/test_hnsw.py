from collections import defaultdict

import numpy as np
import pytest

from offerloom.llm import hnsw

KIND = "vec_id long, embedding array<float>, label int, id long, shard long, v long, score long"


def cosine(a, b):
    total = lambda x: float(np.add.accumulate(x)[-1])
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


def brute(rows, every=50, nearest=5):
    able = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        able[i] = min(able.get(i, v), v)
    width = max((len(v) for v in able.values()), default=0)
    able = {i: np.array(list(map(np.float32, v)) + [0] * (width - len(v)), float) for i, v in able.items()}
    return {q: sorted((-cosine(able[q], v), i) for i, v in able.items() if i != q)[:nearest] for q in able if q % every == 0}


def ask(spark, rows, **how):
    found = defaultdict(list)
    df = spark.createDataFrame([(i, v, 1, 0, 0, 0, 0) for i, v in rows], KIND)
    for r in sorted(hnsw.nearest_report(df, **how).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((-r.score, r.vec_id))
        assert len(found[r.query_id]) == r["rank"]
    return dict(found)


def recall(found, want):
    """Found ones at least as near as the last that is wanted."""
    hit = sum(s <= want[q][-1][0] for q in want if want[q] for s, _ in found.get(q, []))
    return hit / sum(map(len, want.values()))


def rows_of(v):
    return [(i, x) for i, x in enumerate(v.astype(np.float32).tolist())]


def test_exact_on_small_shards_with_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 16))
    hot = np.repeat(base[:1], 300, axis=0)  # one node; a query among its copies finds copies
    near = base[1] + 0.01 * rng.normal(size=(300, 16))
    rows = rows_of(np.vstack([base, hot, near, 2 * base[:50]]))
    assert ask(spark, rows) == {q: w for q, w in brute(rows).items()}


@pytest.mark.parametrize("kind", ["gauss", "clusters", "one cluster"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 32))
    if kind == "clusters":
        v = rng.normal(size=(10, 32))[rng.integers(0, 10, 4000)] + 0.3 * v
    if kind == "one cluster":
        v[:2500] = v[0] + 0.001 * v[:2500]
    rows = rows_of(v)
    found, want = ask(spark, rows), brute(rows)
    assert recall(found, want) >= 0.97 and all(len(found[q]) == 5 for q in want)
    exact = {i: np.array(x) for i, x in rows}
    assert all(s == -cosine(exact[q], exact[i]) and i != q for q, some in found.items() for s, i in some)


def test_recall_of_one_large_shard():
    rng = np.random.default_rng(7)
    v = hnsw.unit_rows(rng.normal(size=(12_000, 64)))
    levels = np.sort(hnsw.levels_of(np.arange(len(v))))[::-1]
    graph = hnsw.build(v, levels)
    q = np.arange(0, len(v), 97)
    found, _ = graph.search(0, v[q], graph.descend(v[q], 0), hnsw.SEARCH_WIDTH)
    best = np.argsort(-(v[q] @ v.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found, best)]) >= 0.93
    assert all(((x >= -1) & (x < len(x))).all() for x in graph.links) and len(graph.links) == levels[0] + 1


def test_awkward_rows(spark):
    bad = [(None, [1.0, 2.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, [None, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, [3e38, 3e38]), (4, [-1.0, 0.0, 0.5]), (350, [1e-38, 2e-38]), (350, [1e-38, 2e-38]), (350, [5.0, 0.0])]
    found = ask(spark, bad + good)
    assert found == brute(bad + good) and set(found) == {0, 350} and len(found[0]) == 5
    assert ask(spark, bad) == {} and ask(spark, []) == {} and ask(spark, [(0, [1.0])]) == {}
    assert ask(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])]) == brute([(0, [1.0, 2.0]), (1, [2.0, 1.0])])


def test_blocks_of_queries_and_more_neighbours(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 40)
    monkeypatch.setattr(hnsw, "SHARD_ROOT", 4)
    rows = rows_of(np.random.default_rng(9).normal(size=(600, 8)))
    assert ask(spark, rows, every=3, nearest=9) == brute(rows, 3, 9)


def test_index_has_every_vector(spark):
    rows = rows_of(np.random.default_rng(2).normal(size=(500, 8)))
    df = spark.createDataFrame([(i, v, 1, 0, 0, 0, 0) for i, v in rows], KIND)
    index = hnsw.build_index(hnsw.vectors_by_id(df), 500, 8).collect()
    assert sorted(i for r in index for i in r.ids) == list(range(500))
    assert all(len(r.neighbours) == r.level + 1 and (r.neighbours[0] or len(index) == 1) for r in index)
