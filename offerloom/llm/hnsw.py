"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards by a hash.  A task builds its shard's graph: nodes stand in
order of falling level, so that level l is the first so many nodes, and each level's links
are one flat array with a row of neighbours a node.  Batches of nodes of one level search
the graph as it is, all at once, and meet the other nodes of their batch besides; of the
nearest found a node links to those that are nearer to it than to a neighbour already taken.
The index is a table, a row for each node with its vector and its neighbours.

Every query searches every shard, and the shards' best are merged.  Queries travel in blocks
of bounded size; a shard is sent once to each block.  What a shard's search finds is measured
again in double precision, one product after the other, before the best are taken, so a score
does not depend on shards or batches.

Equal vectors are one node, which carries its smallest ids: one more than a query wants, which
is all that a result can name.  A vector that a third of all rows repeat is one node, too.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as do
null ids.  A vector shorter than the longest one counts as filled up with zeros.  Rows that
share an id count as one, with the least of their vectors.  Ties go to the smaller id.  Tables
without candidates give no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.common import materialise, mix64
from offerloom.llm.embedding_dedup import usable

#: Neighbours of a node: on upper levels and on the lowest; lists may grow by half before they are cut back.
LINKS, LOWEST_LINKS = 16, 32
#: Nodes kept in view while a node is inserted, and while a query is answered; nodes of a batch.
BUILD_WIDTH, SEARCH_WIDTH, BATCH = 64, 160, 256
#: Shards for n vectors: sqrt(n) / SHARD_ROOT, but none of more than SHARD_BYTES of doubles.
SHARD_ROOT, SHARD_BYTES = 16, 16 << 20
QUERY_BLOCK = 1 << 15
EVERY, NEAREST = 50, 5


def shard_count(n: int, width: int) -> int:
    return max(1, math.ceil(n**0.5 / SHARD_ROOT), math.ceil(n * 8 * width / SHARD_BYTES))


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever the size of their components."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def levels_of(ids: np.ndarray) -> np.ndarray:
    """A level for each id: each level has a node in ``LINKS`` of the one below."""
    u = ((mix64(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return (-np.log(u) / math.log(LINKS)).astype(np.int32)


@dataclass
class Graph:
    """``links[l]``: the neighbours of level l's nodes, which are the first ones of ``vectors``; -1 for none."""

    vectors: np.ndarray
    links: list[np.ndarray]

    def search(self, level: int, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes of a level found for each query from ``entry``, nearest first, and their cosines."""
        links, v, n = self.links[level], self.vectors, len(queries)
        found = np.full((n, width), -1)
        near = np.full((n, width), -np.inf)
        fresh = np.zeros((n, width), bool)  # found, but its neighbours have not been looked at
        found[:, 0], near[:, 0], fresh[:, 0] = entry, np.einsum("nd,nd->n", v[entry], queries), True
        seen = np.zeros((n, len(links)), bool)
        seen[np.arange(n), entry] = True
        rows = np.arange(n)
        while len(rows):
            best = fresh[rows].argmax(axis=1)
            fresh[rows, best] = False
            to = links[found[rows, best]]
            new = (to >= 0) & ~seen[rows[:, None], to]
            who, at = np.nonzero(new)
            node = to[who, at]
            seen[rows[who], node] = True
            cosine = np.full(to.shape, -np.inf)
            cosine[who, at] = np.einsum("nd,nd->n", v[node], queries[rows[who]])
            better = np.flatnonzero((cosine > near[rows, -1:]).any(axis=1))
            if len(better):
                some = rows[better]
                every = np.concatenate([near[some], cosine[better]], axis=1)
                order = np.argsort(-every, axis=1, kind="stable")[:, :width]
                pick = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), order, 1)
                near[some] = np.take_along_axis(every, order, 1)
                found[some], fresh[some] = pick(found[some], to[better]), pick(fresh[some], new[better])
                found[some] = np.where(np.isfinite(near[some]), found[some], -1)
            rows = rows[fresh[rows].any(axis=1)]
        return found, near

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """The nearest node that each query meets above level ``down_to``, from the first node."""
        entry = np.zeros(len(queries), int)
        for level in range(len(self.links) - 1, down_to, -1):
            if len(self.links[level]) > 1:
                entry = self.search(level, queries, entry, 1)[0][:, 0]
        return entry


def spread(v: np.ndarray, found: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) those to link to: first the ones that no
    candidate taken before is nearer to, then the nearest others."""
    vectors = v[found]
    between = vectors @ vectors.transpose(0, 2, 1)
    there = found >= 0
    taken = np.zeros(found.shape, bool)
    for c in range(found.shape[1]):
        crowded = (taken & (between[:, c] > near[:, c, None])).any(axis=1)
        taken[:, c] = there[:, c] & ~crowded & (taken.sum(axis=1) < keep)
    order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(found, order, 1)


def _link_back(graph: Graph, level: int, first: int, chosen: np.ndarray, keep: int) -> None:
    """Neighbours of the nodes from ``first`` on link to these; a list that is full is cut back to ``keep``."""
    links, v = graph.links[level], graph.vectors
    new, at = np.nonzero(chosen >= 0)
    old = chosen[new, at]
    new = new + first
    order = np.lexsort((-np.einsum("nd,nd->n", v[old], v[new]), old))
    old, new = old[order], new[order]
    starts = np.flatnonzero(np.r_[True, old[1:] != old[:-1]]) if len(old) else np.empty(0, int)
    place = np.arange(len(old)) - np.repeat(starts, np.diff(np.r_[starts, len(old)]))
    near_enough = place < links.shape[1]  # the nearest ones of a batch, if it holds very many
    old, new, place = old[near_enough], new[near_enough], place[near_enough]
    nodes, row = np.unique(old, return_inverse=True)
    for some in np.array_split(np.arange(len(nodes)), -(-len(nodes) // 512) or 1):
        if not len(some):
            continue
        mine = (row >= some[0]) & (row <= some[-1])
        added = np.full((len(some), links.shape[1]), -1)
        added[row[mine] - some[0], place[mine]] = new[mine]
        both = np.concatenate([links[nodes[some]], added], axis=1)
        full = (both >= 0).sum(axis=1) > links.shape[1]
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        links[nodes[some[~full]]] = both[~full, : links.shape[1]]
        if full.any():
            who = nodes[some[full]]
            near = np.where(both[full] >= 0, np.einsum("ncd,nd->nc", v[both[full]], v[who]), -np.inf)
            by = np.argsort(-near, axis=1, kind="stable")
            kept = spread(v, np.take_along_axis(both[full], by, 1), np.take_along_axis(near, by, 1), keep)
            links[who] = -1
            links[who[:, None], np.arange(kept.shape[1])] = kept


def build(vectors: np.ndarray, levels: np.ndarray) -> Graph:
    """The graph of unit vectors in order of falling level."""
    sizes = [int((levels >= level).sum()) for level in range(int(levels[0]) + 1)] if len(levels) else []
    graph = Graph(vectors, [np.full((n, (LINKS if level else LOWEST_LINKS) * 3 // 2), -1) for level, n in enumerate(sizes)])
    at = 0
    while at < len(vectors):
        own = int(levels[at])
        end = min(at + max(1, min(at, BATCH)), sizes[own])
        new = vectors[at:end]
        peers = new @ new.T
        np.fill_diagonal(peers, -np.inf)
        entry = graph.descend(new, own) if at else np.zeros(len(new), int)
        for level in range(own, -1, -1):
            found, near = graph.search(level, new, entry, BUILD_WIDTH) if at else (np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf))
            entry = found[:, 0]
            some = np.argsort(-peers, axis=1, kind="stable")[:, :BUILD_WIDTH]
            both, cosine = np.concatenate([found, some + at], axis=1), np.concatenate([near, np.take_along_axis(peers, some, 1)], axis=1)
            by = np.argsort(-cosine, axis=1, kind="stable")[:, :BUILD_WIDTH]
            both, cosine = np.take_along_axis(both, by, 1), np.take_along_axis(cosine, by, 1)
            both = np.where(np.isfinite(cosine), both, -1)
            chosen = spread(vectors, both, cosine, LINKS)
            graph.links[level][at:end, : chosen.shape[1]] = chosen
            # nodes that are in the graph link back, and so do those of the batch, each once
            keep = LINKS if level else LOWEST_LINKS
            known = graph.links[level]
            mutual = np.zeros(chosen.shape, bool)
            inside = chosen >= at
            mutual[inside] = (known[chosen[inside]] == (np.nonzero(inside)[0] + at)[:, None]).any(axis=1)
            _link_back(graph, level, at, np.where(mutual, -1, chosen), keep)
        at = end
    return graph


def exact_cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows, each sum taken from its first product to its last."""
    scaled = []
    for x in (q, v):  # by powers of two, which changes no digit
        with np.errstate(divide="ignore"):
            scaled.append(np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1]))
    total = lambda x: np.add.accumulate(x, axis=-1)[..., -1]
    a, b = scaled
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


_INDEX = "shard int, node int, level int, ids array<long>, v array<double>, neighbours array<array<int>>"
_FOUND = "query_id long, vec_id long, score double"


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as a matrix, short ones filled up with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _build_shard(width: int):
    def build_shard(key: tuple, shard: pa.Table) -> pa.Table:
        ids = shard["id"].to_numpy()
        levels = levels_of(ids)
        order = np.lexsort((ids, -levels))
        shard, levels = shard.take(pa.array(order)), levels[order]
        graph = build(unit_rows(_rows(shard["v"], width)), levels)
        neighbours = [[graph.links[k][i][graph.links[k][i] >= 0].tolist() for k in range(level + 1)] for i, level in enumerate(levels)]
        fixed = [pa.array(np.full(len(ids), key[0].as_py(), np.int32)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(levels)]
        return pa.table([*fixed, shard["ids"].cast(pa.list_(pa.int64())), shard["v"].cast(pa.list_(pa.float64())), pa.array(neighbours, pa.list_(pa.list_(pa.int32())))], names=["shard", "node", "level", "ids", "v", "neighbours"])

    return build_shard


def loaded(index: pa.Table, width: int) -> tuple[Graph, np.ndarray]:
    """A shard's graph from its rows, and its vectors as they are."""
    levels, lists = index["level"].to_numpy(), index["neighbours"].combine_chunks()
    raw = _rows(index["v"], width)
    first, inner = lists.offsets.to_numpy(), lists.values
    ends, nodes = inner.offsets.to_numpy(), inner.flatten().to_numpy(zero_copy_only=False)
    links = []
    for level in range(int(levels.max()) + 1):
        n = int((levels >= level).sum())
        at = first[:n] + level
        lengths = ends[at + 1] - ends[at]
        flat = np.full((n, max(1, int(lengths.max()))), -1)
        flat[np.arange(flat.shape[1]) < lengths[:, None]] = np.concatenate([nodes[ends[a] : ends[a + 1]] for a in at]) if lengths.any() else []
        links.append(flat)
    return Graph(unit_rows(raw), links), raw


def _search_shard(width: int, nearest: int, view: int):
    def search_shard(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if index.num_rows and queries.num_rows:
            index = index.sort_by("node")
            graph, raw = loaded(index, width)
            ids = index["ids"].combine_chunks()
            starts, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
            wanted, vectors = queries["query_id"].to_numpy(), _rows(queries["v"], width)
            for at in range(0, len(wanted), BATCH):
                out += _best(graph, raw, starts, flat, wanted[at : at + BATCH], vectors[at : at + BATCH], nearest, view)
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return search_shard


def _best(graph: Graph, raw: np.ndarray, starts: np.ndarray, flat: np.ndarray, wanted: np.ndarray, vectors: np.ndarray, nearest: int, view: int) -> Iterator[tuple[np.ndarray, ...]]:
    """A shard's best of some queries: (query ids, ids, scores)."""
    unit = unit_rows(vectors)
    found, near = graph.search(0, unit, graph.descend(unit, 0), view)
    # all that may be among the best when measured exactly: the nearest + 1 nodes (one may be the query's own), and their ties
    least = near[:, min(nearest, near.shape[1] - 1), None] - 1e-9
    row, at = np.nonzero((found >= 0) & (near >= least))
    node = found[row, at]
    score = exact_cosines(vectors[row], raw[node])
    each = starts[node + 1] - starts[node]  # a node's ids
    who, value = np.repeat(row, each), np.repeat(score, each)
    names = flat[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[node], each)]
    other = names != wanted[who]
    who, value, names = who[other], value[other], names[other]
    order = np.lexsort((names, -value, who))
    who, value, names = who[order], value[order], names[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, int)
    place = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    keep = place < nearest
    yield wanted[who[keep]], names[keep], value[keep]


def vectors_by_id(vectors: DataFrame) -> DataFrame:
    """``id, v``: the vectors that can be compared, one for each id."""
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))


def build_index(able: DataFrame, n: int, width: int, ids: int = NEAREST + 1) -> DataFrame:
    """The index of ``able(id, v)``: a row for each node.  ``ids``: of equal vectors, how many are named."""
    same = F.sha2(F.array_join("v", ",").cast("binary"), 256)
    first = W.partitionBy("same").orderBy("id")
    few = able.withColumn("same", same).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= ids)
    nodes = few.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    nodes = nodes.select(F.col("ids")[0].alias("id"), "ids", "v").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shard_count(n, width))).cast("int"))
    return materialise(nodes.groupBy("shard").applyInArrow(_build_shard(width), _INDEX))


def search(index: DataFrame, queries: DataFrame, n_queries: int, shards: int, width: int, nearest: int = NEAREST, view: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest of each of ``queries(query_id, v)``."""
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", numbers(shards))
    sent = index.withColumn("block", numbers(blocks))
    key = ["shard", "block"]
    found = sent.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search_shard(width, nearest, view), _FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def nearest_report(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST) -> DataFrame:
    """The nearest of each vector whose id ``every`` divides, among all others."""
    able = materialise(vectors_by_id(vectors))
    queries = F.col("id") % every == 0
    size = able.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(queries).alias("queries")).first()
    n, width = size["n"], size["width"] or 1
    index = build_index(able, n, width, nearest + 1)
    asked = able.where(queries).select(F.col("id").alias("query_id"), "v")
    return search(index, asked, size["queries"], shard_count(n, width), width, nearest)


NEAREST_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
ok AS (SELECT vec_id, min(e) AS e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY vec_id),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, x: a + x)) AS l FROM ok),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_reduce(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]), lambda x, y: x + y) / (a.l * b.l) AS score
  FROM n a JOIN n b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {NEAREST}
"""
