import hashlib
import random

import numpy as np
import regex
from pyspark.sql import functions as F

from offerloom.llm import fim

from .helpers import awkward, docs

UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")
ODD = ["<P>", "a<S>b", "x <M>", "<P", "P> <", "<S", "<<<", "ab\ncd\r\n\t", "é日本𝄞x́", "a" * 5000, "日" * 3000 + "z", "\x00\x7f", " " * 2000, "AZaz@[`{09"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text)
    return len(units), "psm", len(pre), len(mid), sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


def table():
    r = random.Random(4)
    rows = [(1000 + i, t, "en", "s", 0) for i, t in enumerate(ODD * 3)]
    rows += [(2000 + i, "".join(r.choice(["ab", "Z", " ", "é", "𝄞", "<", "P", ">", "S", "\n", "7"]) for _ in range(r.randrange(60))), None, None, None) for i in range(400)]
    return [*awkward(), *rows]


def test_equals_brute_force(spark):
    rows = table()
    found = sorted(map(tuple, fim.fim_report(docs(spark, rows)).collect()), key=repr)
    assert found == sorted(((i, *brute(i, t)) for i, t, *_ in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_output_keeps_columns_and_restores(spark):
    found = fim.fill_in_middle(docs(spark, table()).withColumn("fim", F.lit(1)))
    assert "d" in found.columns and "own" in found.columns
    back = found.select(F.coalesce("text", F.lit("")).alias("text"), fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back"))
    assert back.where("text <> back OR back IS NULL").count() == 0
    cut = found.where("fim.form = 'psm'").select("text", "fim.*").collect()
    assert cut and all(r.output.startswith("<P>" + r.text[: r.prefix_chars] + "<S>") and r.output.endswith("<M>" + r.text[r.prefix_chars : r.prefix_chars + r.middle_chars]) for r in cut)
    assert fim.fim_report(docs(spark, [])).count() == 0


def test_every_cut_by_checkpoints(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(fim, "BLOCK", 64)
    for every in (1, 3, 16):
        monkeypatch.setattr(fim, "EVERY", every)
        for n in (0, 1, 17, 300):
            text = "".join(r.choice(["word", "é", " ", "𝄞", "x", "."]) for _ in range(n))
            data = np.frombuffer(text.encode(), np.uint8)
            index, units = fim.checkpoints(data, every), UNIT.findall(text)
            assert (index.units, index.points) == (len(units), len(text)) and len(index.unit) == max(1, -(-len(units) // every))
            for u in range(len(units) + 1):
                before = "".join(units[:u])
                assert fim.offset_of(data, index, u) == (len(before.encode()), len(before))
