"""Quality classifier: supervised subword embeddings.

A document's features are its words, for each word a mark that says whether it repeats the
word before, and the character n-grams (2 to 4 code points) inside each word, whose white
space on either side counts as a boundary mark.  Every feature is
hashed to one of ``BUCKETS`` learned vectors; a document is their average, and a softmax
over two outputs gives the probability of label 1.  Vectors and outputs are trained by
stochastic gradient descent in numpy on a bounded, documented sample (``per_class`` rows
of each label), chosen by a hash of doc_id.  Every table gets the same number of steps, and
the labels take turns, so a score weighs both alike whatever their shares and however few
rows carry the rarer one.

As the output is linear in the average, a trained model folds into one number for each
bucket.  Scoring then sums these numbers over a text in numpy; long texts are taken in
pieces that end at white space, so that no feature is lost and memory stays bounded.

Null and empty texts, and texts without words, get the bias alone.  Without labels of both
kinds all scores are the share of label 1 (0.5 if there are none).  Labels that are null,
neither 0 nor 1, or contradict each other for a doc_id are not used.  Repeated rows each get
their score; an empty table gives an empty result, and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.common import materialise, text_slices

BUCKET_BITS, DIM = 17, 8
BUCKETS = 1 << BUCKET_BITS
GRAMS = (2, 3, 4)
#: Documents that training looks at, and its rate at the start.
STEPS, RATE = 4000, 2.0
#: Bytes of counted features of each label's documents, beyond which no further document teaches.
SAMPLE_BYTES = 128 << 20
#: Code points handled at once.
CHUNK = 1 << 19
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MUL) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, bucket) arrays of all features of ``texts``."""
    joined = " " + " ".join(texts) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    owner = np.append(owner, owner[-1:])  # the last boundary
    gap = (c == 32) | (c >= 9) & (c <= 13)
    c[gap] = 32
    # words
    edge = np.diff(gap.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _powers(_MUL, len(c)))])
    words = (sums[ends] - sums[starts]) * _powers(_INV, len(c))[starts]
    yield owner[starts], _bucket(words, 1)
    again = np.zeros(len(words), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (owner[starts[1:]] == owner[starts[:-1]])
    yield owner[starts], _bucket(again, 0)
    # n-grams: white space only first or last
    h, inner = c, np.zeros(len(c), bool)
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _MUL + c[n - 1 :]
        inner = inner[:-1] | gap[n - 2 : -1] if n > 2 else np.zeros(len(h), bool)
        if n in GRAMS:
            keep = np.flatnonzero(~inner & ~(gap[: len(h)] & gap[n - 1 :]) if n == 2 else ~inner)
            yield owner[keep], _bucket(h[keep], n)


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text`` in parts of about ``size`` that end at white space (or at its end)."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in " \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts and their places, about ``CHUNK`` code points together; a long text's pieces come alone."""
    at, some, total = [], [], 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            for p in pieces(t):
                yield [i], [p]
            continue
        if total + len(t) > CHUNK and some:
            yield at, some
            at, some, total = [], [], 0
        at.append(i)
        some.append(t)
        total += len(t)
    if some:
        yield at, some


@dataclass
class Model:
    margin: np.ndarray  # by bucket: what a feature adds to the log odds of label 1
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for at, some in chunks(texts):
            for owner, bucket in features(some):
                total[at] += np.bincount(owner, self.margin[bucket], len(some))
                n[at] += np.bincount(owner, minlength=len(some))
        odds = total / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets, and the share of its features in each."""
    ids, counts = np.empty(0, np.int32), np.empty(0, np.int64)
    for _, some in chunks([text]):  # a long text piece by piece
        for _, bucket in features(some):
            new, n = np.unique(np.concatenate([ids, bucket]), return_inverse=True)
            counts = np.bincount(n, np.concatenate([counts, np.ones(len(bucket))]), len(new)).astype(np.int64)
            ids = new
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


def text_shares(text: Column) -> Column:
    """``struct<ids,weights>``: ``shares`` as packed 32-bit numbers, which are small on the driver."""

    @F.arrow_udf("ids binary, weights binary")
    def shares_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [[x.tobytes() for x in shares(t)] for some in text_slices(texts) for t in some]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(2)], names=["ids", "weights"])

    return shares_of(text)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    """SGD over ``steps`` documents (their ``shares``), the two labels in turn, each label's rows in shuffled passes."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)

    def passes(label: int) -> Iterator[int]:
        own = np.flatnonzero(np.asarray(labels) == label)
        while True:
            yield from rng.permutation(own)

    turns = passes(0), passes(1)
    for step in range(steps):
        label = step % 2
        ids, weight = rows[next(turns[label])]
        mean = weight @ vectors[ids]
        z = out @ mean + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        lr = rate * (1 - step / steps)
        vectors[ids] -= (lr * weight)[:, None] * (p @ out)[None, :]
        out -= lr * np.outer(p, mean)
        bias -= 0.1 * lr * p
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of doc_id as text (null: empty), modulo ``folds``; 0 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from at most ``per_class`` documents of each label outside fold 0, and no more of them than have
    ``sample_bytes`` of counted features (the first one always teaches).

    They are chosen among those that have a text, of any length; a doc_id teaches one text, the
    least it has.  Tasks count the features; the driver gets these, ``BUCKETS`` numbers a
    document at most, and no text.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    able = materialise(known.join(texts.select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    counts = dict(known.groupBy("quality").count().collect())
    some = [able.where(F.col("quality") == q).orderBy(*order).limit(per_class).select("doc_id", "quality") for q in (0, 1)]
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not counts else (40.0 if share else -40.0))
    chosen = some[0].union(some[1])  # at most 2 * per_class rows, so it may be broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "quality", text_shares(F.col("text")).alias("s")).select("doc_id", "quality", "s.*")
    rows = materialise(rows)
    size = F.octet_length("ids") + F.octet_length("weights")
    before = F.sum(size.cast("long")).over(W.partitionBy("quality").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))  # per_class rows at most
    few = rows.select("doc_id", "quality", before.alias("before")).where(f"coalesce(before, 0) < {sample_bytes}").select("doc_id", "quality")
    rows = rows.join(F.broadcast(few), ["doc_id", "quality"]).toPandas().sort_values("doc_id")
    if rows["quality"].nunique() < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    return train([(np.frombuffer(i, np.int32), np.frombuffer(w, np.float32)) for i, w in zip(rows["ids"], rows["weights"])], rows["quality"].astype(int).tolist())


def quality_score(text: Column, model: Model) -> Column:
    """``double``: the probability that a text has label 1."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.empty(0), *map(shared.value.scores, text_slices(texts))]))

    return score_of(text)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = docs.select("doc_id", (fold() == 0).alias("held_out"), quality_score(F.col("text"), fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
