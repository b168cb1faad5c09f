"""Embedding near-dedup over a pivot-permutation index.

Some vectors of a bounded sample, chosen by a hash of vec_id, are pivots, none of them near
another.  Every vector is described by its nearest pivots in order, ``described`` of them.
The index is an inverted list for each pivot: the vectors that have it among their first
``listed`` ones, each with its description.  Vectors that meet in a list are candidates if
their descriptions share at least ``least_shared`` pivots.  Vectors that lie far apart
hardly ever share so many, so that the vectors themselves, which are fetched for candidates
only, move about once; then candidates are compared by cosine in double precision.

Equal vectors are one class before anything else.  A long list is cut into blocks of about
``BLOCK`` vectors, and each pair of blocks is a unit of work of its own; it tells every
vector's number of links and one link to its unit's component, never all pairs.  A pair that
shares several lists is counted in that of the smallest pivot.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do
null vec_ids.  A vector shorter than the longest one counts as filled up with zeros.  Rows
that share a vec_id count as one, with the least of their vectors that can be compared, and
each has that one's result.
Among pivots equally near, the first one counts as nearer.  An empty table gives an empty
result, and columns beside ``vec_id`` and ``embedding`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import materialise
from offerloom.llm.graph import components

#: Pivots for n vectors: PIVOT_FACTOR * sqrt(n), at least; at most what fits in PIVOT_BYTES as doubles.
LEAST_PIVOTS, PIVOT_FACTOR, PIVOT_BYTES = 64, 4, 32 << 20
#: Candidates looked at for each pivot, and the cosine from which one is too near an earlier pivot.
CANDIDATES, PIVOT_COSINE = 2, 0.7
BLOCK = 1024
COSINE = 0.9


def usable(v: Column) -> Column:
    """Neither null nor empty, zero, or with a component that is null or not finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows of unit length, in double precision."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    out /= np.abs(out).max(axis=1, keepdims=True)  # keeps squares in range
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def spread_out(candidates: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` pivots, in the candidates' order, none near an earlier one.

    A large group of alike vectors would otherwise hold many pivots, whose order is noise to its members.
    """
    chosen: list[int] = []
    free = np.ones(len(candidates), bool)
    for i in range(len(candidates)):
        if free[i] and len(chosen) < n:
            chosen.append(i)
            free &= candidates @ candidates[i] < PIVOT_COSINE
    found = candidates[chosen]
    return found if len(found) > 1 else np.vstack([found, -found])


def listed(pivots: int) -> int:
    """In how many lists a vector stands: those of its nearest pivots; more as pivots grow denser,
    since a close pair then shares a smaller part of its nearest ones."""
    return min(pivots, max(6, (pivots - 1).bit_length() - 3))


def described(pivots: int) -> int:
    """Nearest pivots in a description."""
    return min(pivots, 3 * listed(pivots) + 6)


def least_shared(pivots: int) -> int:
    """Pivots that the descriptions of a candidate pair share.

    Of pairs at the threshold 99.7 % share three in eight or more (measured for 340 to 4096
    pivots), of pairs of unrelated vectors less than one in ten thousand a quarter.
    """
    return -(-described(pivots) // 4)


def nearest_pivots(v: Column, pivots: np.ndarray, n: int) -> Column:
    """``array<int>``: the ``n`` nearest pivots, nearest first."""

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for i in range(0, len(s), 1024):
                sims = _matrix(s.iloc[i : i + 1024], pivots.shape[1]) @ pivots.T
                near = np.sort(np.argpartition(-sims, n - 1, axis=1)[:, :n], axis=1)
                order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
                out.extend(np.take_along_axis(near, order, 1).astype(np.int32))
            yield pd.Series(out, dtype=object)

    return nearest(v)


UNIT = ["p", "i", "j"]
_FOUND = "id long, links long, root long"


def _candidates(unit: pa.Table, p: int, apart: bool, first: int, least: int) -> np.ndarray:
    """Which rows of a unit of list ``p`` are candidates with each other: their descriptions share
    enough pivots, and ``p`` is the smallest one whose list both stand in.  ``apart``: only rows
    of different blocks."""
    described_by = np.stack(unit["nearest"].to_numpy())
    names, at = np.unique(described_by, return_inverse=True)
    rows = np.arange(len(at.reshape(described_by.shape)))[:, None]
    has = np.zeros((len(rows), len(names)), np.float32)
    has[rows, at.reshape(described_by.shape)] = 1
    found = has @ has.T >= least
    lists = np.zeros_like(has)
    lists[rows, at.reshape(described_by.shape)[:, :first]] = 1
    lower = lists[:, names < p]
    found &= lower @ lower.T == 0
    if apart:
        block = unit["block"].to_numpy()
        found &= block[:, None] != block[None, :]
    np.fill_diagonal(found, False)
    return found


def _meet(first: int, least: int):
    """A unit's rows to those that have a candidate in it."""

    def meet(key: tuple, unit: pa.Table) -> pa.Table:
        p, i, j = (k.as_py() for k in key)
        keep = _candidates(unit, p, i != j, first, least).any(axis=1)
        return unit.filter(pa.array(keep)).select([*UNIT, "block", "id"])

    return meet


def _verify(first: int, least: int, width: int, cosine: float):
    """A unit's candidates, with their vectors, to links."""

    def verify(key: tuple, unit: pa.Table) -> pa.Table:
        p, i, j = (k.as_py() for k in key)
        close = _candidates(unit, p, i != j, first, least)
        vectors, ids, copies = unit["v"].to_pandas(), unit["id"].to_numpy(), unit["copies"].to_numpy()
        m = _matrix(vectors, width)
        sims = m @ m.T
        close &= sims >= cosine - 1e-9
        edge = close & (sims < cosine + 1e-9)  # where the order of a product's sums could decide
        for a, b in zip(*np.nonzero(np.triu(edge, 1))):
            x, y = np.asarray(vectors.iloc[a], float), np.asarray(vectors.iloc[b], float)
            n = min(len(x), len(y))
            exact = np.dot(x[:n], y[:n]) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y)))
            close[a, b] = close[b, a] = exact >= cosine
        label = ids.copy()
        while True:
            new = np.minimum(label, np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (new == label).all():
                break
            label = new
        keep = close.any(axis=1)
        return pa.table({"id": ids[keep], "links": (close @ copies)[keep].astype(np.int64), "root": label[keep]})

    return verify


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding)``."""
    rows = vectors.select("vec_id", "embedding", (usable(F.col("embedding")) & F.col("vec_id").isNotNull()).alias("able"))
    able = rows.where("able").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    able = materialise(able.withColumn("same", F.sha2(F.array_join("embedding", ","), 256)))
    size = able.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    classes = materialise(able.groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    member = materialise(able.select("same", "vec_id").join(classes, "same").select("vec_id", "id", "copies"))
    nodes = able.join(classes, "same").where("vec_id = id").dropDuplicates(["same"]).select("id", "copies", F.col("embedding").alias("v"))
    n_pivots = max(LEAST_PIVOTS, min(PIVOT_BYTES // (8 * max(1, size["width"] or 1)), int(PIVOT_FACTOR * size["n"] ** 0.5)))
    chosen = able.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(CANDIDATES * n_pivots).select("embedding").toPandas()["embedding"]
    if size["n"] < 2:
        found = vectors.sparkSession.createDataFrame([], _FOUND)
    else:
        found = _search(nodes, spread_out(_matrix(chosen, size["width"]), n_pivots), size["width"], cosine)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst"))
    copies = member.where("vec_id <> id").select(F.col("id").alias("src"), F.col("vec_id").alias("dst"))
    named = materialise(components(edges.unionByName(copies)))
    counted = materialise(member.join(links, "id", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.select("vec_id").join(counted, "vec_id", "left").join(named.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _search(nodes: DataFrame, pivots: np.ndarray, width: int, cosine: float) -> DataFrame:
    n = len(pivots)
    first, least = listed(n), least_shared(n)
    nodes = materialise(nodes.withColumn("nearest", nearest_pivots(F.col("v"), pivots, described(n))))
    lists = nodes.select("id", "nearest", F.explode(F.slice("nearest", 1, first)).alias("p"))
    lengths = materialise(lists.groupBy("p").count().where("count > 1").select("p", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    entries = lists.join(F.broadcast(lengths), "p")  # a row for each pivot at most
    # unit (i, j), i <= j, holds blocks i and j
    entries = entries.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = entries.select("p", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "nearest")
    met = materialise(units.groupBy(*UNIT).applyInArrow(_meet(first, least), "p int, i int, j int, block int, id long"))
    fetched = met.join(nodes, "id")
    return materialise(fetched.groupBy(*UNIT).applyInArrow(_verify(first, least, width, cosine), _FOUND))


EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
w AS (SELECT vec_id, min(e) AS e FROM v WHERE e IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY vec_id),
f AS (SELECT vec_id, list_resize(e, (SELECT max(len(e)) FROM w), 0::DOUBLE) AS e FROM w),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM f),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
reach(id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen),
c AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
