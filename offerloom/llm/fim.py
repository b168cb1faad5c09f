"""Fill-in-middle transformation with a sparse checkpoint index.

A text's units are runs of ASCII letters and single other characters.  While its units are
counted, a checkpoint is recorded at every ``EVERY``-th one: which unit it is, and how many
bytes and code points stand before it.  The two cuts depend on the number of units, so they
are known only afterwards; each is found by a binary search among the checkpoints and a scan
of less than ``EVERY`` units from there.  Texts are read in blocks, so that a very long one
needs no memory beside its own bytes and its checkpoints.

Only offsets come back from Python; pieces are cut out of the bytes, put together, taken
apart again and digested by built-in functions.

Null texts are empty, and an empty text stays plain, as do texts that hold one of the marks.
A null doc_id draws as an empty one; rows that share a doc_id draw alike, so equal rows give
equal results.  An empty table gives an empty result.  The other columns stay, whatever
their names; a column ``fim`` is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import text_or_empty

EVERY, BLOCK = 512, 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts: how many are cut, and how many of these have their suffix first.
CUT, SUFFIX_FIRST = 90, 20


def unit_starts(block: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where units and where code points begin in a block of UTF-8, and whether it ends with a letter."""
    letter = ((block | 0x20) - np.uint8(97)) < 26
    first = (block & 0xC0) != 0x80
    goes_on = letter.copy()
    goes_on[1:] &= letter[:-1]
    goes_on[:1] &= after_letter
    return first & ~goes_on, first, bool(letter[-1]) if len(block) else after_letter


@dataclass
class Checkpoints:
    """Every ``EVERY``-th unit of a text with the bytes and code points before it, and the text's totals."""

    unit: list[int]
    byte: list[int]
    point: list[int]
    units: int
    points: int


def checkpoints(text: np.ndarray, every: int = EVERY) -> Checkpoints:
    unit, byte, point = [0], [0], [0]
    units = points = 0
    after_letter = False
    for at in range(0, len(text), BLOCK):
        starts, first, after_letter = unit_starts(text[at : at + BLOCK], after_letter)
        where = np.flatnonzero(starts)
        due = where[-units % every :: every]  # the block's units whose number is a multiple
        if len(due):
            before = np.cumsum(first)[due] - 1 + points
            numbers = units + -units % every + every * np.arange(len(due))
            fresh = numbers > 0
            unit += numbers[fresh].tolist()
            byte += (due[fresh] + at).tolist()
            point += before[fresh].tolist()
        units += len(where)
        points += int(np.count_nonzero(first))
    return Checkpoints(unit, byte, point, units, points)


def offset_of(text: np.ndarray, index: Checkpoints, unit: int) -> tuple[int, int]:
    """Bytes and code points before a unit (before the end, if ``unit`` is the number of units)."""
    if unit == index.units:
        return len(text), index.points
    i = bisect_right(index.unit, unit) - 1
    at, point, left, after_letter = index.byte[i], index.point[i], unit - index.unit[i], False
    while True:
        starts, first, after_letter = unit_starts(text[at : at + 8 * EVERY], after_letter)
        where = np.flatnonzero(starts)
        if left < len(where):
            return at + int(where[left]), point + int(np.count_nonzero(first[: where[left]]))
        left -= len(where)
        point += int(np.count_nonzero(first))
        at += len(first)


_CUTS = "struct<n:long,byte1:long,point1:long,byte2:long,point2:long>"


def cut_offsets(text: Column, draw1: Column, draw2: Column) -> Column:
    """``struct<n,byte1,point1,byte2,point2>``: the number of units, and the offsets of the cuts after
    draw % (n + 1) units, the smaller first; null offsets for null draws."""
    names = ["n", "byte1", "point1", "byte2", "point2"]

    @F.arrow_udf(_CUTS)
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            rows = []
            bodies = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
            for body, a, b in zip(bodies, first.to_pylist(), second.to_pylist()):
                data = np.frombuffer(body.as_buffer() if body.is_valid else b"", np.uint8)
                index = checkpoints(data)
                if a is None or b is None:
                    rows.append((index.units, None, None, None, None))
                    continue
                low, high = sorted(x % (index.units + 1) for x in (a, b))
                rows.append((index.units, *offset_of(data, index, low), *offset_of(data, index, high)))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)

    return cuts(text, draw1, draw2)


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits for a document: the first hex digits of a digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with ``fim struct<n,form,prefix_chars,middle_chars,output>`` added.

    ``form`` is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    """
    body = text_or_empty(text)
    h = draws(F.col(key), seed)
    marked = F.greatest(*(F.instr(body, m) for m in (PREFIX, SUFFIX, MIDDLE))) > 0
    form = F.when((body == "") | marked | (h[2] % 100 >= cut), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    drawn = lambda x: F.when(form != "plain", x)
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "fim")).alias("row"), body.alias("body"), form.alias("form"), cut_offsets(body, drawn(h[0]), drawn(h[1])).alias("at"))
    raw = F.col("body").cast("binary")
    piece = lambda low, high: F.substring(raw, low + 1, (high - low).cast("int"))
    one, two = F.col("at.byte1").cast("int"), F.col("at.byte2").cast("int")
    prefix, middle, suffix = piece(F.lit(0), one), piece(one, two), piece(two, F.octet_length(raw))
    mark = lambda m: F.lit(m).cast("binary")
    output = (
        F.when(F.col("form") == "plain", raw)
        .when(F.col("form") == "psm", F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle))
        .otherwise(F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle))
    )
    done = F.struct(F.col("at.n").alias("n"), "form", F.col("at.point1").alias("prefix_chars"), (F.col("at.point2") - F.col("at.point1")).alias("middle_chars"), output.cast("string").alias("output"))
    return rows.select("row.*", done.alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; a text that is cut holds no mark, so each mark stands once."""
    between = lambda s, a, b: F.split_part(F.split_part(s, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    head = lambda s, b: F.substring(F.split_part(s, F.lit(b), F.lit(1)), 4, 1 << 30)
    last = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(head(output, SUFFIX), last, between(output, SUFFIX, MIDDLE))
    spm = F.concat(between(output, PREFIX, MIDDLE), last, head(output, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    f = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return f.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_DRAW = "('0x' || substr(h, {}, 8))::BIGINT"
FIM_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, {_DRAW.format(1)} AS h1, {_DRAW.format(9)} AS h2, {_DRAW.format(17)} AS h3, {_DRAW.format(25)} AS h4 FROM d),
f AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
