"""Small tables with every awkward case, and rows as plain values."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have columns of the same names.
CLASHES = ("size", "key", "part", "id", "n", "component", "h", "copies", "copy", "finish", "score", "label", "same", "uid", "low", "high", "f", "s", "shard", "place", "rank", "nth", "gram", "target", "host", "d", "own", "doc")
WORDS = "amber basil cedar delta ember fjord grove hazel inlet jolly kelp lunar maple north ocean pearl quill river stone tulip umber vivid wheat xenon yarrow zebra".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))


def near(text, seed, n):
    """``text`` with ``n`` words changed."""
    r, w = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def awkward():
    long = prose(1, 30_000)
    base = prose(2, 300)
    texts = [None, "", " \t\n ", "one", "Two words", base, base, base.upper(), near(base, 3, 4), near(base, 4, 4), near(base, 5, 100), long, near(long, 6, 50), "é日本 𝄞 x", "a b\x1cc", "x" * 5000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(50 + i, 40 + i), "en", "s0", 0) for i in range(30)]
    return [*rows, rows[5], (None, "no id here at all", None, None, None)]


def docs(spark, rows=None, extra=True):
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASHES}) if extra else df


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
