"""Merkle manifest of a dataset by mountain ranges over indexed partitions.

Leaves are dealt by ranges of their order and counted, which gives every partition the index
in its tree that it begins at.  A partition pushes its leaves onto a stack; whenever the last
``FANOUT`` entries fill an aligned run, they carry into their parent, as digits do when one
counts in base ``FANOUT``.  Each parent is a node record; what stays on the stack are the
partition's peaks.  A partition may begin and end anywhere, so its peaks at both edges belong
to runs of its neighbours: groups of neighbouring partitions push their peaks, in order, onto
a stack of their own, until one group has a whole tree.  There the last run of each level is
closed as it is, short or even of one node; nothing is padded.

A leaf's siblings inside its partition are found again from the partition's leaves.  Those
outside are peaks of other partitions or nodes of the merging, at most 2 * ``FANOUT`` a level
and partition; each partition is sent just these.  The roots of all trees are the leaves of
one more tree, grown in the same way.  No task sees more than a partition's leaves or a
group's peaks, and a tree that holds most rows is as many partitions as any rows of that
number.

Null trees, orders and fields are values of their own (nulls first); leaves of equal order
stand by digest, and equal rows side by side, so that all roots are defined.  Rows are
told apart only by what they hold: repeated rows are leaves of their own.  An empty table has
no leaves, nodes or roots.  Very long texts are digested where they are read and go nowhere.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from offerloom.llm.common import materialise

FANOUT = 2
#: Leaves of a partition, and partitions whose peaks are merged in one group.
LEAVES, FAN_IN = 1 << 15, 16

Node = tuple[int, int, str]  # level, index in the level, digest


def digest(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def widths(total: int, fanout: int) -> list[int]:
    """Nodes of each level that has several."""
    found = []
    while total > 1:
        found.append(total)
        total = -(-total // fanout)
    return found


def mountains(items: Iterable[Node], fanout: int) -> tuple[list[Node], list[Node]]:
    """Neighbouring nodes, in order, to (what stays on the stack, parents made)."""
    stack: list[Node] = []
    made: list[Node] = []
    for node in items:
        stack.append(node)
        level, i, _ = node
        while i % fanout == fanout - 1 and len(stack) >= fanout and stack[-fanout][:2] == (level, i - fanout + 1):
            node = (level + 1, i // fanout, digest(h for _, _, h in stack[-fanout:]))
            stack[-fanout:] = [node]
            made.append(node)
            level, i, _ = node
    return stack, made


def closed(peaks: list[Node], total: int, fanout: int) -> tuple[str, list[Node]]:
    """All peaks of a tree of ``total`` leaves to (its root, nodes over short runs)."""
    stack, made = list(peaks), []
    last: Node | None = None
    for level in range(len(widths(total, fanout))):
        run = [last] if last else []
        while stack and stack[-1][0] == level:
            run.insert(0, stack.pop())
        last = (level + 1, run[0][1] // fanout, digest(h for _, _, h in run)) if run else None
        made += [last] if last else []
    return (last or stack[0])[2], made


def outside(start: int, end: int, total: int, fanout: int) -> list[tuple[int, int]]:
    """(level, index) of the siblings that leaves ``start`` to ``end`` have in other partitions, or across them."""
    found, span = [], 1
    for level, width in enumerate(widths(total, fanout)):
        runs = {start // span // fanout, (end - 1) // span // fanout}
        members = [i for run in sorted(runs) for i in range(run * fanout, min(width, (run + 1) * fanout))]
        found += [(level, i) for i in members if not start <= i * span <= (i + 1) * span <= end]
        span *= fanout
    return found


def sibling_arrays(leaves: list[str], start: int, total: int, known: dict[tuple[int, int], str], fanout: int) -> pa.Array:
    """For each of a partition's leaves, level by level, the others of its run, left to right."""
    end, index = start + len(leaves), start + np.arange(len(leaves))
    pool: list[str] = []
    taken, here, span = [], leaves, 1
    first = start  # index of here[0]
    for level, width in enumerate(widths(total, fanout)):
        low, high = start // span // fanout * fanout, min(width, ((end - 1) // span // fanout + 1) * fanout)
        own = index // span
        members = own[:, None] // fanout * fanout + np.arange(fanout)
        taken.append(np.where((members < width) & (members != own[:, None]), members - low + len(pool), -1))
        pool += [here[i - first] if first <= i < first + len(here) else known.get((level, i)) for i in range(low, high)]
        begin, stop = -(-first // fanout), (first + len(here)) // fanout
        here = [digest(here[i * fanout - first : (i + 1) * fanout - first]) for i in range(begin, stop)]
        first, span = begin, span * fanout
    at = np.stack(taken, axis=1) if taken else np.empty((len(leaves), 0, fanout), np.int64)
    values = pa.array(pool, pa.string()).take(pa.array(at[at >= 0]))
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((at >= 0).sum(axis=2).ravel())]), pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1) * at.shape[1], pa.int32()), runs)


_RECORD = "tree string, part long, level int, idx long, digest string, total long, kind string"


def _records(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = ["tree", "part", "level", "idx", "digest", "total", "kind"]
    return pa.table([pa.array(list(column), kind) for column, kind in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)


def _runs(table: pa.Table, units: pa.Table):
    """A partition's leaves by tree: (unit's row, first leaf, last + 1)."""
    where = {t: k for k, t in enumerate(units["tree"].to_pylist())}
    trees = table["tree"].combine_chunks().dictionary_encode("encode")
    codes = trees.indices.to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield where[trees.dictionary[int(codes[a])].as_py()], int(a), int(b)


def _stack(fanout: int):
    """A partition to its node records, its peaks and the siblings it needs from others."""

    def stack(table: pa.Table, units: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        leaves, rows = table["leaf"].to_pylist(), []
        unit = units.to_pylist()
        for k, a, b in _runs(table, units):
            tree, part, start, total = (unit[k][c] for c in ("tree", "part", "start", "total"))
            peaks, made = mountains(((0, start + i, h) for i, h in enumerate(leaves[a:b])), fanout)
            rows += [(tree, part, level, i, h, total, "node") for level, i, h in made]
            rows += [(tree, part, level, i, h, total, "peak") for level, i, h in peaks]
            rows += [(tree, part, level, i, None, total, "need") for level, i in outside(start, start + b - a, total, fanout)]
        return _records(rows)

    return stack


def _join_peaks(fanout: int, whole: bool):
    """The peaks of a group of neighbouring partitions to node records, and to peaks or the tree's root."""

    def join_peaks(key: tuple, table: pa.Table) -> pa.Table:
        tree, part = (k.as_py() for k in key)
        items = sorted(zip(*(table[c].to_pylist() for c in ("level", "idx", "digest"))), key=lambda x: x[1] * fanout ** x[0])
        total = table["total"][0].as_py()
        peaks, made = mountains(items, fanout)
        if whole:
            root, over = closed(peaks, total, fanout)
            return _records([(tree, part, level, i, h, total, "node") for level, i, h in made + over] + [(tree, part, None, None, root, total, "root")])
        return _records([(tree, part, level, i, h, total, "node") for level, i, h in made] + [(tree, part, level, i, h, total, "peak") for level, i, h in peaks])

    return join_peaks


def _paths(fanout: int, more: list[str]):
    def paths(table: pa.Table, units: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        leaves, unit = table["leaf"].to_pylist(), units.select(["start", "total", "edges"]).to_pylist()
        row_unit, index, siblings = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64), []
        for k, a, b in _runs(table, units):
            known = {(e["level"], e["idx"]): e["digest"] for e in unit[k]["edges"] or []}
            row_unit[a:b], index[a:b] = k, unit[k]["start"] + np.arange(b - a)
            siblings.append(sibling_arrays(leaves[a:b], unit[k]["start"], unit[k]["total"], known, fanout))
        taken = units.select(more).take(pa.array(row_unit))
        for name in more:
            table = table.append_column(name, taken[name])
        return table.append_column("index", pa.array(index)).append_column("siblings", pa.chunked_array(siblings, pa.list_(pa.list_(pa.string()))))

    return paths


@dataclass
class Forest:
    """Trees over leaves.  ``nodes(tree, level, idx, digest)``: all nodes above the leaves;
    ``roots(tree, total, root)``: a row for each tree."""

    leaves: DataFrame  # part, nth and the given columns
    units: DataFrame  # part, tree, start, total, edges
    nodes: DataFrame
    roots: DataFrame
    fanout: int

    def paths(self, more: DataFrame | None = None) -> DataFrame:
        """The leaves with ``index`` in their tree and ``siblings``; ``more``: columns by tree to be added."""
        units, names = self.units, []
        if more is not None:
            names = [c for c in more.columns if c != "tree"]
            units = units.join(more.withColumnRenamed("tree", "of"), F.col("tree").eqNullSafe(F.col("of"))).drop("of")
        added = units.select(*names).schema.fields
        kind = StructType([*self.leaves.schema.fields, *added]).add("index", "long").add("siblings", ArrayType(ArrayType(StringType())))
        return self.leaves.groupBy("part").cogroup(units.groupBy("part")).applyInArrow(_paths(self.fanout, names), kind).drop("part", "nth")


def forest(rows: DataFrame, order: list[str], fanout: int = FANOUT, leaves: int = LEAVES, fan_in: int = FAN_IN) -> Forest:
    """Trees over ``rows(tree string, leaf string, *order, ...)``, leaves by ``order``, then by digest."""
    # equal rows get different places in the deal, so that a range can end among them
    rows = materialise(rows.withColumn("nth", F.monotonically_increasing_id()))
    parts = max(1, -(-rows.count() // leaves))
    keys = ["tree", *order, "leaf", "nth"]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = materialise(dealt.withColumns({"nth": F.monotonically_increasing_id(), "part": F.spark_partition_id().cast("long")}))
    counts = dealt.groupBy("part", "tree").count()  # a row for each partition and tree in it
    each = W.partitionBy("tree")
    before = F.sum("count").over(each.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    units = materialise(counts.select("part", "tree", F.coalesce(before, F.lit(0)).alias("start"), F.sum("count").over(each).alias("total")))
    found = materialise(dealt.select("part", "nth", "tree", "leaf").groupBy("part").cogroup(units.groupBy("part")).applyInArrow(_stack(fanout), _RECORD))
    peaks = first = found.where("kind = 'peak'")
    nodes, above = [found.where("kind = 'node'")], []
    last = dealt.agg(F.max("part")).first()[0] or 0
    while True:
        last //= fan_in
        joined = peaks.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("tree", "part").applyInArrow(_join_peaks(fanout, last == 0), _RECORD)
        joined = materialise(joined)
        above.append(joined.where("kind = 'node'"))
        if last == 0:
            break
        peaks = joined.where("kind = 'peak'")
    sent = first
    for x in above:
        sent = sent.unionByName(x)
    sent = sent.select(F.col("tree").alias("of"), F.col("level").alias("at"), F.col("idx").alias("i"), "digest")
    need = found.where("kind = 'need'").select("part", "tree", "level", "idx")
    met = need.join(sent, F.col("tree").eqNullSafe(F.col("of")) & (F.col("level") == F.col("at")) & (F.col("idx") == F.col("i")))
    edges = met.groupBy("part", "tree").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("edges"))  # 2 * fanout a level at most
    edges = edges.withColumnsRenamed({"part": "p", "tree": "t"})
    units = materialise(units.join(edges, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")), "left").drop("p", "t"))
    for x in above:
        nodes.append(x)
    every = nodes[0]
    for x in nodes[1:]:
        every = every.unionByName(x)
    roots = joined.where("kind = 'root'").select("tree", "total", F.col("digest").alias("root"))
    return Forest(dealt, units, every.select("tree", "level", "idx", "digest"), roots, fanout)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as bytes of its text, a colon and the text, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    said = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def folded(leaf: Column, index: Column, siblings: Column, fanout: int = FANOUT) -> Column:
    """The root that a leaf has by its siblings."""

    def step(acc: Column, run: Column) -> Column:
        place = (acc["i"] % fanout).cast("int")
        joined = F.concat(F.array_join(F.slice(run, 1, place), ""), acc["h"], F.array_join(F.slice(run, place + 1, F.lit(fanout)), ""))
        return F.struct(F.sha2(joined.cast("binary"), 256).alias("h"), F.floor(acc["i"] / fanout).cast("long").alias("i"))

    return F.aggregate(siblings, F.struct(leaf.alias("h"), index.cast("long").alias("i")), step)["h"]


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass
class Manifest:
    """``leaves(doc_id, lang, leaf, index, siblings, tree_index, tree_siblings, subroot, root, ...)``;
    ``nodes`` and ``roots`` of each lang's tree; ``top``: the tree over their roots."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    top: Forest


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None, **sizes: int) -> Manifest:
    """The manifest of ``docs``; ``extra``: columns of ``docs`` that its leaves carry."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("tree"), leaf_digest(*map(F.col, FIELDS)).alias("leaf"), *(c.alias(n) for n, c in (extra or {}).items()))
    trees = forest(rows, ["doc_id"], **sizes)
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("leaf"))
    top = forest(subroots, ["lang"], **sizes)
    placed = top.paths(top.roots.select("tree", "root")).select(
        F.col("lang").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("index").alias("tree_index"), F.col("siblings").alias("tree_siblings")
    )
    return Manifest(trees.paths(materialise(placed)).withColumnRenamed("tree", "lang"), trees.nodes, trees.roots, top)


def merkle_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; every seventh doc_id by
    its checksum is shown with one character more than the manifest has."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = leaf_digest(*(F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS))
    m = manifest(docs, {"shown": shown}).leaves
    proof = F.array_join(F.concat(F.flatten("siblings"), F.flatten("tree_siblings")), "")
    up = folded(folded(F.col("shown"), F.col("index"), F.col("siblings")), F.col("tree_index"), F.col("tree_siblings"))
    out = m.select("doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), up.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_SAID = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda n: f"sha256({' || '.join(_SAID(n if c == 'n_chars' else c) for c in FIELDS)})"
#: crc32 is not a function there; this is its polynomial over the bits of a decimal's digits.
_CRC = (
    "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * length(doc_id::VARCHAR)), lambda j: (ascii(substr(doc_id::VARCHAR, (j // 8 + 1)::BIGINT, 1)) >> (j % 8))::UBIGINT & 1::UBIGINT)),"
    " lambda c, b: CASE WHEN xor(c & 1::UBIGINT, b) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"
)
_TREE = "SELECT {t}, 0 AS k, i, {h} AS h, n FROM {l} UNION ALL SELECT {t}, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {u} WHERE n > 1 GROUP BY {t}, k, i // 2, n"
_PATH = (
    "SELECT l.{t}, l.i, list(CASE WHEN s.h IS NULL THEN '-' WHEN (l.i >> v.k) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY v.k) FILTER (WHERE v.k IS NOT NULL) AS path"
    " FROM {l} l LEFT JOIN (SELECT DISTINCT {t}, k FROM {u} WHERE n > 1) v ON v.{t} IS NOT DISTINCT FROM l.{t}"
    " LEFT JOIN {u} s ON s.{t} IS NOT DISTINCT FROM l.{t} AND s.k = v.k AND s.i = xor(l.i >> v.k, 1) GROUP BY l.{t}, l.i"
)
_FOLD = "list_reduce(list_prepend({h}, coalesce({p}, [])), lambda a, s: CASE s[1] WHEN '-' THEN sha256(a) WHEN 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END)"
MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS claimed FROM documents),
e AS (SELECT doc_id, lang, {_LEAF('n_chars')} AS leaf, {_LEAF('claimed')} AS shown FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM e),
u AS ({_TREE.format(t='lang', h='leaf', l='l', u='u')}),
p AS ({_PATH.format(t='lang', l='l', u='u')}),
m AS (SELECT 0 AS one, lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM u WHERE n = 1),
w AS ({_TREE.format(t='one', h='subroot', l='m', u='w')}),
q AS ({_PATH.format(t='one', l='m', u='w')}),
f AS (SELECT doc_id, leaf, subroot, (SELECT h FROM w WHERE n = 1) AS root, coalesce(p.path, []) AS a, coalesce(q.path, []) AS b, {_FOLD.format(h='shown', p='p.path')} AS half
  FROM l JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i JOIN m ON m.lang IS NOT DISTINCT FROM l.lang JOIN q ON q.i = m.i),
g AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(list_concat(a, b), lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256, {_FOLD.format(h='half', p='b')} AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM g
"""
