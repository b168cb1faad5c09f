"""LM scoring by cross-entropy difference.

Two word bigram models share one vocabulary (hashes of all words of the corpus, A-Z in
lower case; a word that a model has not seen is one of ``WORDS`` equally likely ones) and one
way of smoothing: one of all documents (the background), one of the target documents.  A
word's probability after another is its bigram's count, with ``MU`` counts more dealt out as
the word's own probability says, which in turn is its count with ``MU`` counts dealt out
evenly.  The background's counts are scaled to the target's total, so that the models are
matched in size.  A document never vouches for itself: its own counts are taken out of the
models it is part of before it is scored.  Its score is the mean, over its words, of target
loss less background loss in bits; low scores read like the target.

Counts cover every word of every text, and what is gathered grows with the corpus: nothing is
pruned, and no table is broadcast.  Texts are dealt once, by a hash of doc_id, to chunks of
about ``CHUNK`` characters, where they meet their labels.  A chunk sends each of its distinct
words and bigrams once, packed, to the bucket that its hash belongs to (about ``BUCKET`` of
them in each), buckets add up what all chunks have sent and answer every chunk with the
corpus' counts, and the chunk, whose texts are still where they were dealt to, scores its
documents.  A frequent bigram is one entry of each chunk, so no bucket grows hot; rows of a
doc_id that repeats more than ``HOT`` times are dealt to several chunks.

A text's beginning is a word of its own that is never predicted.  Null and empty texts have no
words and the score null.  Without target documents the target model is the smoothing alone.
Repeated rows and equal texts each count and each get a row.  A doc_id labelled more than once
is a target if any of its labels says so.  Very long texts count whole.  An empty table gives
an empty result; other columns of the documents are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import materialise, mix64
from offerloom.llm.mixing import n_words

MU, WORDS = 2.0, float(1 << 20)
#: Characters of a chunk, and entries that a bucket gets, about.
CHUNK, BUCKET = 3 << 20, 1_000_000
#: Rows of a doc_id that may go to one chunk.
HOT = 10_000
#: Most doc_ids in a broadcast list of those that repeat so often.
BROADCAST_IDS = 2_000_000
_START = np.uint64(0x5354415254)


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Grams:
    """The words and bigrams of a chunk's texts.

    ``keys`` are the sorted hashes of the distinct ones; ``word``, ``before`` and ``pair`` say, for
    every word of every text, where the word, the one before it and both stand there, and
    ``owner`` which text it is of.
    """

    def __init__(self, texts: list[str | None]):
        found = [word_hashes(t or "") for t in texts]
        self.n = np.array([len(x) for x in found], np.int64)
        words = np.concatenate([np.empty(0, np.uint64), *(x for h in found for x in ([_START], h) if len(h))])
        inner = np.ones(len(words), bool)
        has = self.n[self.n > 0]
        inner[np.cumsum(has + 1) - has - 1] = False
        single = mix64(words)
        pair = mix64(single[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:])[inner[1:]] if len(words) else words
        # 56 bits of a hash: a byte less to send for each key
        self.keys, at = np.unique(np.concatenate([single, pair]) >> np.uint64(8), return_inverse=True)
        place = np.flatnonzero(inner)
        self.every, self.word, self.before, self.pair = at[: len(words)], at[place], at[place - 1], at[len(words) :]
        self.owner = np.repeat(np.arange(len(texts)), self.n)
        self.all_owner = np.repeat(np.arange(len(texts)), np.where(self.n > 0, self.n + 1, 0))

    def counts(self, texts: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts that the flags name."""
        size = len(self.keys)
        return np.bincount(self.every[texts[self.all_owner]], minlength=size) + np.bincount(self.pair[texts[self.owner]], minlength=size)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every word: how often its word, the one before and its bigram occur in its own text."""
        size = max(1, len(self.keys))
        held, n = np.unique(np.concatenate([self.all_owner * size + self.every, self.owner * size + self.pair]), return_counts=True)
        return tuple(n[np.searchsorted(held, self.owner * size + x)] if len(x) else x for x in (self.word, self.before, self.pair))


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes in front, which compresses well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).ravel()


ASKED = "bucket long, chunk long, keysum long, keys binary, background binary, target binary"
TOLD = "bucket long, chunk long, keysum long, background binary, target binary"


def keysum(keys: np.ndarray) -> int:
    """By which answers are told to belong to the same keys as the questions."""
    return int(np.add.reduce(keys, dtype=np.uint64).astype(np.int64))


def _ask(buckets: int):
    """A chunk's documents and target ids to what it asks of each bucket."""

    def ask(key: tuple, docs: pa.Table, good: pa.Table) -> pa.Table:
        ids = docs["doc_id"].to_pylist()
        g = Grams(docs["text"].to_pylist())
        wanted = set(good["doc_id"].to_pylist())
        background, target = (g.counts(np.array(f, bool)).astype(np.uint32) for f in ([True] * len(ids), [i in wanted for i in ids]))
        bucket = ((g.keys >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
        rows = [(int(bucket[a]), key[0].as_py(), keysum(g.keys[a:b]), pack(g.keys[a:b]), pack(background[a:b]), pack(target[a:b])) for a, b in zip(cuts, cuts[1:])]
        return _table(rows, [("bucket", pa.int64()), ("chunk", pa.int64()), ("keysum", pa.int64()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary())])

    return ask


def _table(rows: list[tuple], names: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(names)], schema=pa.schema(names))


def _tell(asked: pa.Table) -> pa.Table:
    """A bucket's questions to the sums over all chunks, in each question's order."""
    parts = [unpack(k, np.uint64) for k in asked["keys"].to_pylist()]
    at = np.unique(np.concatenate(parts), return_inverse=True)[1]
    ends = np.cumsum([0, *map(len, parts)])
    sums = []
    for name in ("background", "target"):
        own = np.concatenate([unpack(x, np.uint32) for x in asked[name].to_pylist()])
        total = np.bincount(at, own).astype(np.uint64)[at]
        sums.append(pa.array([pack(total[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()))
    return pa.table([asked["bucket"], asked["chunk"], asked["keysum"], *sums], names=["bucket", "chunk", "keysum", "background", "target"])


def _score(words: float, target_words: float, doc_id: pa.DataType):
    """A chunk's documents, and the answers and target ids that belong to it, to their losses."""
    totals = {"background": words, "target": target_words}
    kinds = [("doc_id", doc_id), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())]

    def score(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids = docs["doc_id"]
        g = Grams(docs["text"].to_pylist())
        told = told.sort_by("bucket")
        wanted = set(told["doc_id"].to_pylist()) - {None}
        answers = told.filter(pa.compute.is_valid(told["background"]))
        if keysum(answers["keysum"].to_numpy().astype(np.uint64)) != keysum(g.keys):
            raise ValueError("a chunk's answers are another chunk's: its documents were dealt anew in between")
        part = {"background": np.ones(len(docs)), "target": np.array([i in wanted for i in ids.to_pylist()], float)}
        own = g.own()
        n = np.maximum(g.n, 1)
        out = []
        for m in ("target", "background"):
            counts = np.concatenate([np.empty(0, np.uint64), *(unpack(x, np.uint64) for x in answers[m].to_pylist())]).astype(float)
            mine = part[m][g.owner]
            word, before, pair = (counts[at] - mine * o for at, o in zip((g.word, g.before, g.pair), own))
            rest = np.maximum(1.0, totals[m] - part[m] * g.n)[g.owner]
            scale = np.maximum(1.0, totals["target"] - part["target"] * g.n)[g.owner] / rest
            p1 = (word * scale + MU / WORDS) / (rest * scale + MU)
            p2 = (pair * scale + MU * p1) / (before * scale + MU)
            out.append(np.bincount(g.owner, -np.log2(p2), len(docs)) / n)
        return pa.table([ids, pa.array(g.n), *map(pa.array, out)], schema=pa.schema(kinds))

    return score


def lm_losses(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, n_tokens and both models' mean loss of every row of ``docs(doc_id, text)``; ``good(doc_id)`` names the targets."""
    spark = docs.sparkSession
    good = good.where("doc_id IS NOT NULL").select("doc_id").distinct()
    per = docs.groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(n_words(F.col("text"))).alias("words"), F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"))
    per = materialise(per.join(good.withColumn("good", F.lit(True)), "doc_id", "left"))
    total = per.agg(F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.sum(F.when(F.col("good"), F.col("words"))).alias("target")).first()
    words, target = (float(total[k] or 0) for k in ("words", "target"))
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * deal, math.ceil((total["chars"] or 0) / CHUNK))
    buckets = max(deal, math.ceil(words / BUCKET))
    # rows of a doc_id that repeats without end, or has none, are dealt over several chunks
    spread = F.ceil(F.greatest(F.col("rows") / HOT, F.col("chars") / CHUNK)).cast("long")
    hot = materialise(per.where(f"rows > 1 AND (rows > {HOT} OR chars > {CHUNK}) AND doc_id IS NOT NULL").select("doc_id", spread.alias("spread")))
    n_hot = hot.count()
    # rows are numbered as they are read, before anything is shuffled, so that a lost task deals them as before
    slim, ids = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("nth")), good
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        slim, ids = slim.join(hot, "doc_id", "left"), ids.join(hot, "doc_id", "left")
        ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("spread", F.lit(1).cast("long")) - 1)))
    else:
        slim, ids = slim.withColumn("spread", F.lit(1).cast("long")), ids.withColumn("salt", F.lit(0).cast("long"))
    salt = F.when(F.col("doc_id").isNull(), F.col("nth")).otherwise(F.col("nth") % F.coalesce("spread", F.lit(1).cast("long")))
    chunk = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(chunks)).cast("long").alias("chunk")
    dealt = slim.withColumn("salt", salt).select(chunk, "doc_id", "text")
    ids = ids.select(chunk, "doc_id")
    asked = dealt.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_ask(buckets), ASKED)
    told = asked.groupBy("bucket").applyInArrow(_tell, TOLD)
    kind = docs.schema["doc_id"].dataType
    answers = told.withColumn("doc_id", F.lit(None).cast(kind)).unionByName(ids.select("chunk", "doc_id", F.lit(-1).cast("long").alias("bucket")), allowMissingColumns=True)
    from pyspark.sql.pandas.types import to_arrow_type

    score = _score(words, target, to_arrow_type(kind))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"doc_id {kind.simpleString()}, n_tokens long, target_loss double, background_loss double")


def lm_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores against the documents labelled as of good quality."""
    scored = lm_losses(docs, labels.where("quality = 1"))
    return scored.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("target_loss") - F.col("background_loss")))
