import math
from collections import Counter

from offerloom.llm import lm_score as lm

from .helpers import CLASHES, awkward, by_id, docs, near, prose


def tokens(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def brute(rows, good):
    """Both models by plain counting, each document's own counts taken out."""
    def grams(text):
        w = [None, *tokens(text)]
        return Counter(w if len(w) > 1 else []) + Counter(zip(w, w[1:]))

    models = {"b": Counter(), "t": Counter()}
    total = {"b": 0, "t": 0}
    for i, t, *_ in rows:
        for m in "bt" if i in good else "b":
            models[m] += grams(t)
            total[m] += len(tokens(t))
    out = []
    for i, t, *_ in rows:
        w, own = [None, *tokens(t)], grams(t)
        n = len(w) - 1
        loss = {"b": 0.0, "t": 0.0}
        for m in loss:
            mine = lambda k: k == "b" or i in good
            left = {k: max(1, total[k] - n * mine(k)) for k in total}
            scale = left["t"] / left[m]
            c = lambda g: (models[m][g] - own[g] * mine(m)) * scale  # noqa: E731, B023
            for a, b in zip(w, w[1:]):
                p1 = (c(b) + lm.MU / lm.WORDS) / (left[m] * scale + lm.MU)
                loss[m] -= math.log2((c((a, b)) + lm.MU * p1) / (c(a) + lm.MU))
        out.append((i, n, loss["t"] / max(1, n), loss["b"] / max(1, n)))
    return out


def labels(spark, ids):
    return spark.createDataFrame([(i, 1, 0) for i in ids] + [(None, 1, 0), (3, 0, 0), (100, None, 0)], "doc_id long, quality int, toxic int")


def equal(want, found):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert len(found) == len(want)
    for a, b in zip(sorted(want, key=key), sorted((tuple(r)[:4] for r in found), key=key)):
        assert a[:2] == b[:2] and all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a[2:], b[2:])), (a, b)


def test_losses_equal_brute_force(spark):
    good = {5, 101, 102, 103, 13, 11}
    found = lm.lm_report(docs(spark), labels(spark, [*good, 5])).collect()
    equal(brute(awkward(), good), found)
    assert all((r.score is None) == (r.n_tokens == 0) for r in found)


def test_small_chunks_and_repeated_ids(spark, monkeypatch):
    """Many chunks and buckets, and doc_ids that repeat beyond what a chunk takes, change nothing."""
    monkeypatch.setattr(lm, "CHUNK", 2000)
    monkeypatch.setattr(lm, "BUCKET", 300)
    monkeypatch.setattr(lm, "HOT", 5)
    rows = awkward() + [(7, prose(1, 30), "en", "s", 0)] * 23 + [(8, prose(2, 30), "en", "s", 0)] * 12 + [(None, prose(3, 20), "en", "s", 0)] * 9
    rows += [((1 << 60) + i, prose(900, 12), "en", "s", 0) for i in range(3)]
    equal(brute(rows, {7, 101, (1 << 60) + 1}), lm.lm_report(docs(spark, rows).repartition(7), labels(spark, [7, 101, (1 << 60) + 1])).collect())


def test_a_copy_elsewhere_shows(spark):
    rows = [(i, prose(i, 200), "en", "s", 0) for i in range(60)]
    rows += [(100, near(prose(7, 200), 1, 4), "en", "s", 0)]
    found = by_id(lm.lm_report(docs(spark, rows), labels(spark, range(0, 60, 2))))
    alone = [r.background_loss for i, r in found.items() if i not in (7, 100)]
    assert max(found[7].background_loss, found[100].background_loss) < 0.7 * min(alone)


def test_empty_tables(spark):
    assert set(CLASHES) < set(docs(spark).columns)
    assert lm.lm_report(docs(spark, []), labels(spark, [])).count() == 0
    assert len(by_id(lm.lm_report(docs(spark), labels(spark, []).limit(0)))) > 40


def test_packing():
    import numpy as np

    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 5):
            x = np.arange(n).astype(kind) * 77
            assert (lm.unpack(lm.pack(x), kind) == x).all()
