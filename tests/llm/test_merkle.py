import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from offerloom.llm import merkle

from .helpers import awkward, docs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(i, text, lang, source, n):
    return H(*(said(v) for v in (i, source, lang, n, text)))


def tree(leaves, fanout=2):
    """Root, and for each leaf the levels of (others of its run, own place)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for p, k in zip(paths, at):
            run, place = runs[k // fanout], k % fanout
            p.append((run[:place] + run[place + 1 :], place))
        at, level = [k // fanout for k in at], [H(*r) for r in runs]
    return level[0] if level else None, paths


def up(leaf, path):
    for others, place in path:
        leaf = H(*others[:place], leaf, *others[place:])
    return leaf


def brute(rows, fanout=2):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    out, subroots, paths = [], [], []
    for lang in langs:
        some = sorted(((r, leaf_of(*r)) for r in by_lang[lang]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        root, path = tree([h for _, h in some], fanout)
        subroots.append(root)
        paths.append((some, path))
    root, tops = tree(subroots, fanout)
    for (some, path), subroot, top in zip(paths, subroots, tops):
        for (r, leaf), p in zip(some, path):
            n = r[4] if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 or r[4] is None else r[4] + 1
            fold = up(leaf_of(*r[:4], n), p + top)
            out.append((r[0], leaf, subroot, root, H(*(h for others, _ in p + top for h in others)), fold, fold == root))
    return sorted(out, key=repr)


def table():
    rows = [(i, t, "en" if i and i % 3 else ["de", None, "fr"][(i or 0) % 3 if i else 1], s, n) for i, t, _, s, n in awkward()]
    rows += [(500 + i, f"text {i}", "en", "s", i) for i in range(300)] + [(501, "text 1", "en", "s", 1)] * 3 + [(501, "other", "en", "s", None), (7, "lone", "zz", None, 4)]
    return rows


def test_equals_brute_force(spark):
    rows = table()
    found = sorted(map(tuple, merkle.merkle_report(docs(spark, rows)).collect()), key=repr)
    assert found == brute(rows) and {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("leaves, fan_in, fanout", [(7, 2, 2), (40, 3, 2), (11, 2, 3), (5, 4, 5)])
def test_any_partitions_and_fanouts(spark, leaves, fan_in, fanout):
    """Partitions begin anywhere, so runs cross their edges; merging takes several rounds."""
    rows = table()
    m = merkle.manifest(docs(spark, rows), leaves=leaves, fan_in=fan_in, fanout=fanout)
    up_to = merkle.folded(merkle.folded(F.col("leaf"), F.col("index"), F.col("siblings"), fanout), F.col("tree_index"), F.col("tree_siblings"), fanout)
    proof = F.sha2(F.array_join(F.concat(F.flatten("siblings"), F.flatten("tree_siblings")), "").cast("binary"), 256)
    found = m.leaves.select("doc_id", "leaf", "subroot", "root", proof, (up_to == F.col("root")).alias("ok")).collect()
    want = brute(rows, fanout)
    assert sorted(map(tuple, found), key=repr) == sorted(((*r[:5], True) for r in want), key=repr)
    # every node of every level, once
    for r in m.roots.collect():
        have = sorted((x.level, x.idx) for x in m.nodes.where(F.col("tree").eqNullSafe(F.lit(r.tree))).collect())
        sizes, n = [], r.total
        while n > 1:
            n = -(-n // fanout)
            sizes.append(n)
        assert have == [(k + 1, i) for k, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17])
def test_small_tables(spark, n):
    rows = [(i, "same", "en" if i % 2 else None, "s", 1) for i in range(n)]
    assert sorted(map(tuple, merkle.merkle_report(docs(spark, rows)).collect()), key=repr) == brute(rows)


def test_only_repeated_rows(spark):
    rows = [(5, "same", "en", "s", 1)] * 101
    m = merkle.manifest(docs(spark, rows), leaves=10)
    assert m.leaves.select("index").distinct().count() == 101 and m.leaves.select("root").distinct().count() == 1
    assert m.leaves.first().root == brute(rows)[0][3]
