import numpy as np
import pytest

from offerloom.llm import neardup
from offerloom.llm.common import table
from offerloom.llm.graph import components

from .helpers import awkward, docs, near, prose


def sets(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size=4):
    """component by doc_id, set sizes"""
    own = [(i, sets(t, size)) for i, t, *_ in rows]
    ids = {i: i for i, _ in own if i is not None}

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                ids[y] = x
    return {i: root(i) for i in ids}


def check(found, rows, size=4):
    want = brute(rows, size)
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in found) == sorted(len(sets(t, size)) for _, t, *_ in rows)


@pytest.mark.parametrize("size", [4, 5])
def test_awkward_rows(spark, size):
    check(neardup.near_classes(docs(spark), size=size).collect(), awkward(), size)
    assert neardup.near_classes(docs(spark, [])).count() == 0


def test_large_group_near_the_threshold(spark):
    """Copies of one text, edited so much that many pairs of them, but not all, are links."""
    base = prose(9, 160)
    rows = [(i, near(base, i, 1 + i % 7), "en", "s", 0) for i in range(120)]
    rows += [(200 + i, base, "en", "s", 0) for i in range(40)] + [(300 + i, near(base, 1000 + i, 12), "en", "s", 0) for i in range(60)]
    check(neardup.near_classes(docs(spark, rows)).collect(), rows)


def test_driver_table(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    check(neardup.near_classes(d).collect(), [tuple(r) for r in d.select("doc_id", "text", "lang", "source", "n_chars").collect()])


def test_sketches_estimate_similarity(spark):
    base = prose(3, 800)
    a = neardup.samples(neardup.shingles(base, 4))
    for edits, _ in ((0, 0), (10, 0), (20, 0), (40, 0)):
        other = near(base, 77, edits) if edits else base
        b = neardup.samples(neardup.shingles(other, 4))
        x, y = sets(base, 4), sets(other, 4)
        rows = spark.createDataFrame([(neardup.sketch(a)[1].tolist(), neardup.sketch(b)[1].tolist())], "a array<long>, b array<long>")
        guess = rows.select(neardup.estimate(rows.a, rows.b)).first()[0]
        assert abs(guess - len(x & y) / len(x | y)) < 0.15
    assert np.array_equal(neardup.shingles("A b  c\td", 4), neardup.shingles("a B c d", 4))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (200, 199)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + k: 100 for k in range(50)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
