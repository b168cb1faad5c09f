"""MinHash near-dedup with odd sketches.

A document is the set of its distinct word shingles (64-bit hashes; four words unless told
otherwise; all words of a shorter text).  ``BANDS * ROWS`` MinHash samples of the set serve
twice: bands of them name buckets in which alike documents meet, and all of them, folded by
parity into a bitmap of ``SKETCH_BITS`` (an odd sketch), say how alike two documents are:
the bits in which two bitmaps differ count the samples that differ.  Pairs that the bitmaps
put far below the threshold go no further; for the others the whole sets are compared, and
only that comparison makes a link.

No bucket emits all its pairs.  Documents with equal sets are one class before anything
else.  Then each bucket's classes are compared with its smallest member only, links become
components, and what has not joined its bucket's smallest member is compared with the
largest one.  At last, classes that still lie in another component than the bucket's
smallest member are compared with all others of the bucket, apart from those already in
their own component; so every pair that meets in a bucket is either compared or known to be
connected.  A pair at the threshold misses all buckets with a chance of
(1 - 0.8^5)^32 = 3e-6.

Rows without words have an empty set and link with nothing, as do null texts.  Rows that
share a doc_id count as one document.  A null doc_id links with nothing; its component is null.
Of equal sets the smallest doc_id stands for all, and of a component it stays.  Very long texts
are read whole, a short slice of a batch at a time; an empty table gives an empty result, and
columns beside ``doc_id`` and ``text``, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import materialise, mix64, text_slices
from offerloom.llm.graph import components

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Per cent of the union that two sets share at least.
THRESHOLD = 80
#: Candidates stay while their estimate is at least this; six deviations below the threshold.
ESTIMATE = 0.6
#: Most ids in a broadcast set.
BROADCAST_ROWS = 2_000_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SAMPLES, np.uint64)

def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: bytes lower-cased A-Z, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    if not n:
        return h
    run = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        run = mix64(run ^ h[k : len(h) - n + 1 + k])
    return np.unique(run)


def samples(hashes: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        part = hashes[None, i : i + 4096] * _A[:, None] + _B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


_BAND = mix64(np.arange(BANDS, dtype=np.uint64))
_SLOT = mix64(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1 << 20))


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch of MinHash samples, as signed 64-bit numbers."""
    keys = _BAND.copy()
    for column in found.reshape(BANDS, ROWS).T:
        keys = mix64(keys ^ column)
    at = mix64(found ^ _SLOT) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return keys.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


FEATURE_TYPE = "n long, low long, high long, bands array<long>, sketch array<long>"


def document_features(text: Column, size: int) -> Column:
    """``struct<n,low,high,bands,sketch>``: set size, 128-bit fingerprint of the set, band keys, odd sketch."""

    kinds = [("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]

    def of(t: str) -> tuple:
        h = shingles(t, size)
        if not len(h):
            return (0, None, None, None, None)
        whole = xxhash.xxh3_128_intdigest(h.tobytes())
        low, high = (int(np.uint64(x).view(np.int64)) for x in (whole & (1 << 64) - 1, whole >> 64))
        return (len(h), low, high, *sketch(samples(h)))

    @F.arrow_udf(FEATURE_TYPE)
    def features_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [of(t) for some in text_slices(texts) for t in some]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[x for x, _ in kinds])

    return features_of(text)


def shingle_sets(text: Column, size: int) -> Column:
    @F.arrow_udf("array<long>")
    def sets_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingles(t, size).view(np.int64) for some in text_slices(texts) for t in some], pa.list_(pa.int64()))

    return sets_of(text)


def estimate(a: Column, b: Column) -> Column:
    """Similarity that two odd sketches stand for."""
    words = SKETCH_BITS // 64
    apart = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(1, words)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))
    inside = 1 - 2 * apart / F.lit(float(SKETCH_BITS))
    return F.when(inside > 0, 1 + F.lit(SKETCH_BITS / (4 * SAMPLES)) * F.log(inside)).otherwise(0.0)


def _alike(n1: Column, n2: Column, s1: Column, s2: Column, threshold: int) -> Column:
    """What a pair must satisfy before its sets are compared; the sizes alone rule out many."""
    return (100 * F.least(n1, n2) >= threshold * F.greatest(n1, n2)) & (estimate(s1, s2) >= ESTIMATE * threshold / 80)


def near_classes(docs: DataFrame, size: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = materialise(docs.select("doc_id", document_features(F.col("text"), size).alias("f"), F.monotonically_increasing_id().alias("uid")).select("doc_id", "uid", "f.*"))
    able = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(able.groupBy("low", "high").agg(F.min("doc_id").alias("id"), F.min("uid").alias("uid")))
    same = able.select("low", "high", "doc_id").join(classes, ["low", "high"]).where("doc_id <> id").select(F.col("id").alias("src"), F.col("doc_id").alias("dst"))
    # one row of each class, apart from the doc_id, carries its features
    nodes = materialise(classes.select("id", "uid").join(rows.select("uid", "n", "bands", "sketch"), "uid").drop("uid"))
    links = _links(docs, nodes, size, threshold)
    found = materialise(components(same.unionByName(links)))
    named = found.select(F.col("node").alias("doc_id"), "component")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id")).drop("component")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, nodes: DataFrame, size: int, threshold: int) -> DataFrame:
    """``src, dst``: links between classes that connect whatever any link connects."""
    banded = nodes.select("id", F.explode("bands").alias("key"))
    buckets = materialise(banded.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"))
    members = materialise(banded.join(buckets, "key"))
    slim = nodes.select("id", "n", "sketch")

    def screened(pairs: DataFrame) -> DataFrame:
        """``a < b`` of ``pairs(a, b)`` once each, as far as sizes and sketches allow."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        for end in ("a", "b"):
            pairs = materialise(pairs).join(slim.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)
        return materialise(pairs.where(_alike(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"), threshold)).select("a", "b"))

    first = screened(members.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")))
    # whose sets will be compared: now, or in buckets of three and more later
    wanted = materialise(first.select(F.col("a").alias("doc_id")).union(first.select("b")).union(members.where("members > 2").select("id")).distinct())
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = materialise(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").select("doc_id", shingle_sets(F.col("text"), size).alias("s")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("doc_id").alias(end), F.col("s").alias(f"s_{end}")), end)
        return materialise(pairs.where(_exact(F.col("s_a"), F.col("s_b"), threshold)).select(F.col("a").alias("src"), F.col("b").alias("dst")))

    def labelled(links: DataFrame) -> DataFrame:
        """Members of buckets of three and more with their own label and that of the bucket's smallest."""
        found = materialise(components(links))
        mine = found.select(F.col("node").alias("id"), F.col("component").alias("label"))
        its = found.select(F.col("node").alias("low"), F.col("component").alias("low_label"))
        named = members.where("members > 2").join(mine, "id", "left").join(its, "low", "left")
        return named.withColumn("label", F.coalesce("label", "id")).withColumn("low_label", F.coalesce("low_label", "low"))

    links = confirmed(first)
    outside = labelled(links).where("label <> low_label AND id <> high")
    links = materialise(links.unionByName(confirmed(screened(outside.select(F.col("id").alias("a"), F.col("high").alias("b"))))))
    held = labelled(links).where("id <> low").join(slim, "id")
    whole = sets.join(nodes.select(F.col("id").alias("doc_id"), "bands"), "doc_id")
    return links.unionByName(_rest(held, whole, threshold))


def _exact(a: Column, b: Column, threshold: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= threshold * (F.size(a) + F.size(b) - both)


def _rest(held: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links across components that still share a bucket.

    Many pairs just below the threshold may meet here, so pairs are not made rows: what a
    row may match is asked by semi-joins first, then sets are compared inside the join,
    and only links come out.
    """
    held = materialise(held)
    side = lambda df, x: df.select(*(F.col(c).alias(f"{x}_{c}") for c in ("key", "id", "label", "n", "sketch")), (F.col("label") == F.col("low_label")).alias(f"{x}_inside"))
    left = side(held.where("label <> low_label"), "l")
    right = side(held, "r")
    # both ends outside: once, by order; one end inside: from the outside one
    meets = (F.col("l_key") == F.col("r_key")) & (F.col("l_label") != F.col("r_label")) & (F.col("r_inside") | (F.col("l_id") < F.col("r_id")))
    meets = meets & _alike(F.col("l_n"), F.col("r_n"), F.col("l_sketch"), F.col("r_sketch"), threshold)
    left = materialise(left.join(right, meets, "left_semi"))
    right = materialise(right.join(left, meets, "left_semi"))
    own = lambda x: sets.select(F.col("doc_id").alias(f"{x}_id"), F.col("s").alias(f"{x}_set"), F.col("bands").alias(f"{x}_bands"))
    left, right = left.join(own("l"), "l_id"), right.join(own("r"), "r_id")
    # of the buckets that a pair shares, the first one's compares the sets
    once = F.get(F.array_intersect("l_bands", "r_bands"), 0) == F.col("l_key")
    found = left.join(right, meets & once & _exact(F.col("l_set"), F.col("r_set"), threshold))
    return materialise(found.select(F.least("l_id", "r_id").alias("src"), F.greatest("l_id", "r_id").alias("dst")).distinct())


NEARDUP_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM w),
so AS (SELECT doc_id, list_sort(s) AS s FROM sh WHERE len(s) > 0),
one AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM so GROUP BY s),
post AS (SELECT id, n, unnest(s) AS g FROM one),
pairs AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM post a JOIN post b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= {THRESHOLD} * (na + nb - c)
          UNION SELECT one.id, so.doc_id FROM so JOIN one ON so.s = one.s WHERE so.doc_id <> one.id),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, seen) AS (SELECT doc_id, doc_id FROM sh UNION SELECT reach.id, ends.b FROM reach JOIN ends ON ends.a = reach.seen)
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, r.c AS component_id, sh.doc_id = r.c AS kept
FROM sh JOIN (SELECT id, min(seen) AS c FROM reach GROUP BY id) r ON r.id = sh.doc_id
"""
