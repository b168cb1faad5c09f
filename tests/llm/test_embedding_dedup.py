import numpy as np
import pytest

from offerloom.llm.embedding_dedup import COSINE, _search, near_vectors

from .helpers import by_id

KIND = "vec_id long, embedding array<float>, label int, id long, links long"


def brute(rows):
    able = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in able])
    close = m @ m.T >= 0.9
    np.fill_diagonal(close, False)
    label = np.array([i for i, _ in able])
    while True:
        new = np.minimum(label, np.where(close, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            return {i: (int(n), int(c)) for (i, _), n, c in zip(able, close.sum(axis=1), label)}
        label = new


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = base[:60] + 0.02 * rng.normal(size=(60, 16))
    hot = base[0] + 0.01 * rng.normal(size=(1500, 16))  # more than a block
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.vstack([base, near, hot]))]
    rows += [(5000, rows[7][1]), (5001, None), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [float("inf")] + [1.0] * 15), (5006, [])]
    df = spark.createDataFrame([(i, v, 1, 0, 0) for i, v in rows] + [(None, rows[3][1], 1, 0, 0)], KIND)
    found, want = by_id(near_vectors(df), "vec_id"), brute(rows)
    assert len(found) == len(rows) + 1
    links = sum(found[i].n_links for i in want) / sum(n for n, _ in want.values())
    assert 0.97 < links <= 1 and all(found[i].n_links <= n for i, (n, _) in want.items())
    assert np.mean([found[i].component_id == c for i, (_, c) in want.items()]) > 0.99
    for i in (5001, 5002, 5003, 5004, 5005, 5006):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[None].n_links == 0


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.93, size=(1500, 1))
    both = np.vstack([a, c * a + np.sqrt(1 - c * c) * b]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1, 0, 0) for i, v in enumerate(both)], KIND)
    assert sum(r.n_links for r in near_vectors(df).collect()) >= 0.95 * 3000


@pytest.mark.parametrize("n_pivots", [64, 474, 1500, 4096])
def test_recall_at_the_threshold_for_any_number_of_pivots(spark, n_pivots):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b, pivots = (unit(rng.normal(size=(n, 64))) for n in (1000, 1000, n_pivots))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = COSINE + 1e-6
    both = np.vstack([a, c * a + np.sqrt(1 - c * c) * b])
    nodes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(both)], "id long, copies long, v array<double>")
    links = sum(r.links for r in _search(nodes, pivots, 64, COSINE).collect())
    assert 0.98 * 2000 <= links <= 2000


def test_empty_and_repeated(spark):
    assert near_vectors(spark.createDataFrame([], KIND)).count() == 0
    one = near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1, 0, 0)], KIND)).first()
    assert (one.n_links, one.component_id, one.kept) == (0, 1, True)
    twins = near_vectors(spark.createDataFrame([(2, [1.0, 0.0], 1, 0, 0), (1, [1.0, 0.0], 2, 0, 0)], KIND)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in twins) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_repeated_ids_are_one_vector(spark):
    """Rows that share an id link with no row of their own, and count once for the others."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, a), (3, a), (4, b), (4, b), (5, b), (5, a), (6, [1.0]), (7, None), (7, b)]
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame([(i, v, 1, 0, 0) for i, v in rows], KIND)).collect()]
    want = [(1, 2, 1, True)] * 2 + [(3, 2, 1, False)] + [(4, 2, 4, True)] * 2 + [(5, 2, 4, False)] * 2 + [(6, 2, 1, False)] + [(7, 2, 4, False)] * 2
    assert sorted(found) == sorted(want)


def test_random_tables_with_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(21)
    for seed in range(3):
        base = rng.normal(size=(40, 6))
        v = base[rng.integers(0, 40, 200)] + 0.1 * rng.normal(size=(200, 6)) * (rng.random((200, 1)) < 0.7)
        ids = rng.integers(0, 150, 200).tolist()
        rows = list(zip(ids, v.astype(np.float32).tolist()))
        least: dict[int, list] = {}
        for i, x in rows:
            least[i] = min(least.get(i, x), x)
        want, found = brute(sorted(least.items())), near_vectors(spark.createDataFrame([(i, x, 1, 0, 0) for i, x in rows], KIND)).collect()
        assert len(found) == len(rows) and all((r.n_links, r.component_id) == want[r.vec_id] for r in found)


@pytest.mark.parametrize("n_pivots", [64, 900, 4096])
def test_unrelated_vectors_are_no_candidates(n_pivots):
    """What the shared pivots leave to be compared: nearly nothing but what is near."""
    from offerloom.llm import embedding_dedup as ed

    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots, v = unit(rng.normal(size=(n_pivots, 64))), unit(rng.normal(size=(1200, 64)))
    nearest = np.argsort(-(v @ pivots.T), axis=1)[:, : ed.described(n_pivots)]
    has = np.zeros((len(v), n_pivots))
    np.put_along_axis(has, nearest, 1, axis=1)
    share = (np.triu(has @ has.T, 1) >= ed.least_shared(n_pivots)).sum() / (len(v) * (len(v) - 1) / 2)
    assert share < (1e-3 if n_pivots > 64 else 1)


def test_blocks_of_a_long_list(spark, monkeypatch):
    from offerloom.llm import embedding_dedup as ed

    monkeypatch.setattr(ed, "BLOCK", 40)
    rng = np.random.default_rng(11)
    hot = rng.normal(size=16) + 0.1 * rng.normal(size=(300, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.vstack([hot, rng.normal(size=(100, 16))]))]
    found, want = by_id(near_vectors(spark.createDataFrame([(i, v, 1, 0, 0) for i, v in rows], KIND)), "vec_id"), brute(rows)
    assert sum(found[i].n_links for i in want) >= 0.97 * sum(n for n, _ in want.values()) and all(found[i].n_links <= n for i, (n, _) in want.items())
    assert np.mean([found[i].component_id == c for i, (_, c) in want.items()]) > 0.99
