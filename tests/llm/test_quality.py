import zlib

from pyspark.sql import functions as F

from offerloom.llm import quality
from offerloom.llm.common import table

from .helpers import awkward, by_id, docs, prose


def test_held_out_accuracy(spark):
    d, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    found = by_id(quality.quality_report(d, labels))
    held = [(found[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(found) == d.count() and all(r.held_out for r, _ in held)
    assert sum(r.predicted == q for r, q in held) >= 0.97 * len(held)
    again = by_id(quality.quality_report(d.repartition(7), labels))
    assert all(abs(again[k].score - r.score) < 1e-9 for k, r in found.items())


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    d, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    flipped = labels.withColumn("quality", F.when(quality.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = by_id(quality.quality_report(d, labels)), by_id(quality.quality_report(d, flipped))
    assert all(a[k].score == b[k].score for k in a)


def test_awkward_rows_and_labels(spark):
    odd = spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 0, 0), (6, 1, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    for labels in (odd, odd.limit(0)):
        found = quality.quality_report(docs(spark), labels).collect()
        assert len(found) == len(awkward()) and all(0 <= r.score <= 1 for r in found)
    assert quality.quality_report(docs(spark, []), odd).count() == 0


def test_long_texts_are_scored_in_pieces():
    model = quality.Model(quality.np.random.default_rng(1).normal(size=quality.BUCKETS).astype("float32"), 0.1)
    text = " ".join(f"word{i % 997}" for i in range(200_000))
    assert len(list(quality.pieces(text))) > 1 and "".join(quality.pieces(text)) == text
    assert abs(model.scores([text])[0] - model.scores(["a b", text, ""])[1]) < 1e-12


def test_sample_is_full_and_has_one_text_of_a_document(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(quality, "train", lambda rows, labels: taught.append((rows, labels)))
    texts = {i: [None] if i % 3 == 0 else ["b" * 600_000, f"a {i}"] if i % 2 else [f"c {i} " * 200_000] for i in range(60)}
    d = spark.createDataFrame([(i, t) for i, some in texts.items() for t in some], "doc_id long, text string")
    quality.fit(d, spark.createDataFrame([(i, i // 2 % 2) for i in range(60)], "doc_id long, quality int"), per_class=10)
    rows, labels = taught[0]
    assert sorted(labels) == [0] * 10 + [1] * 10
    known = [quality.shares(min(t for t in some if t)) for some in texts.values() if some != [None]]
    assert all(any(len(ids) == len(k) and (ids == k).all() and (w == v).all() for k, v in known) for ids, w in rows)


def plain_scores(texts, vectors, out, bias):
    """The average of a text's feature vectors, and a softmax over the outputs; features one by one."""
    found = []
    for t in texts:
        buckets = [b for _, bucket in quality.features([t]) for b in bucket.tolist()] if t else []
        mean = sum((vectors[b].astype(float) for b in buckets), quality.np.zeros(vectors.shape[1])) / max(1, len(buckets))
        z = out.astype(float) @ mean + bias
        e = quality.np.exp(z - z.max())
        found.append(float(e[1] / e.sum()))
    return found


def test_scores_equal_average_and_softmax():
    np = quality.np
    rng = np.random.default_rng(3)
    vectors, out, bias = rng.normal(size=(quality.BUCKETS, quality.DIM)), rng.normal(size=(2, quality.DIM)), rng.normal(size=2)
    model = quality.Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))
    texts = [t or "" for _, t, *_ in awkward()]
    assert np.allclose(model.scores(texts), plain_scores(texts, vectors, out, bias), atol=1e-9)


def test_features_are_words_repeats_and_inner_grams():
    """Equal features share a bucket, others don't (but for rare collisions)."""
    bag = lambda t: sorted(b for _, bucket in quality.features([t]) for b in bucket.tolist())
    assert bag("ab cd") == bag(" ab\t cd\n") != bag("cd ab e")
    n = lambda t: sum(len(b) for _, b in quality.features([t]))
    # a word, its repeat mark, and of " ab " the n-grams of 2 to 4 code points with the boundary at an end only
    assert n("ab") == 2 + 3 + 2 + 1 and n("ab ab") == 2 * n("ab")


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Documents teach in the order of the sample until their features fill the bound; the first one always does."""
    rows = [(i, prose(i, 40) if i % 2 else "junk " * 40, "en", "s", 0) for i in range(60)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    taught = []
    monkeypatch.setattr(quality, "train", lambda rows, labels, **how: taught.append(labels))
    for bound in (1 << 40, 1, 3000):
        quality.fit(d, labels, sample_bytes=bound)
    every, one, some = taught
    assert sorted(one) == [0, 1] and len(one) < len(some) < len(every) and some.count(0) > some.count(1)
