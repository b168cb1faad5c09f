import hashlib

from pyspark.sql import functions as F

from offerloom.llm import fingerprints as fp
from offerloom.llm.fingerprints import fingerprint_report

from .helpers import awkward, by_id, docs


def shingles(text):
    w = [x for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_likeness(spark):
    found = fingerprint_report(docs(spark)).collect()
    rows = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in awkward()))
    assert len(found) == len(rows)
    found = sorted(found, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_chars))
    prints = {}
    for i, ((key, text), r) in enumerate(zip(rows, found)):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), key
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if len(text) > 200:
            assert abs(r.near_edited - jaccard(shingles(text), shingles(edited))) < 0.2
            assert abs(r.near_next - jaccard(shingles(text), shingles(after))) < 0.2
    assert prints[""] == "" and all(len(p) == 128 for t, p in prints.items() if t.split(" ") != [""] and t.strip())


def test_no_python_in_the_plan_and_empty_table(spark):
    report = fingerprint_report(docs(spark))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert fingerprint_report(docs(spark, [])).count() == 0
    assert fingerprint_report(docs(spark, [(1, "only one here", "en", "s", 3)])).first().near_next == 1.0


def plain_digits(hashes):
    """One bin after the other: its least hash; an empty one's is that of the first bin in its order that has one."""
    least = {}
    for h in hashes:
        b = (h >> (64 - fp.BIN_BITS)) + fp.BINS // 2
        least[b] = min(h, least.get(b, h))
    orders = fp._orders(fp.BINS)
    pick = lambda b: least[b] if b in least else next((least[o] for o in orders[b][: fp.PROBES] if o in least), None)
    found = [pick(b) for b in range(fp.BINS)]
    return "".join("0123456789abcdef"[h % 16] if h is not None else "?" for h in found) if least else "", found.count(None)


def test_digits_equal_a_plain_loop(spark):
    texts = [t or "" for _, t, *_ in awkward()] + ["a b c d e f g h", " ".join(f"w{i}" for i in range(60))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fp.fingerprint(F.col("t")).alias("f"), fp.shingle_hashes(F.col("t")).alias("h")).collect()
    for r in rows:
        want, beyond = plain_digits(r.h)
        assert len(want) == len(r.f) and all(a in (b, "?") for a, b in zip(want, r.f)), r.t[:40]
        assert beyond == 0 or len(set(r.h)) < 2 * fp.BINS
        if len(set(r.h)) == 1:
            assert len(set(r.f)) == 1
