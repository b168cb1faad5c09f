"""Document fingerprints: one-permutation MinHash, densified and packed.

Every five-word shingle (all words of a text with fewer) is hashed once.  The hash's leading
bits name one of ``BINS`` bins, and each bin keeps its smallest hash.  An empty bin borrows
from another one that isn't empty; which one is fixed by the bin alone, by a random order
of all bins in which the first one that isn't empty is taken (optimal densification).
Of each bin's hash the low four bits are kept, one hex digit a bin.  Two fingerprints that
agree in m of k digits are alike (m/k - 1/16) / (1 - 1/16), clamped to 0..1, which corrects
for digits that agree by chance.

Everything is built-in array functions.  A text without words has the empty fingerprint,
which is alike 1 to itself and 0 to any other.  Null texts are empty.  Very long texts are
fingerprinted whole.  The next document is the next row by doc_id (nulls first), of equal
doc_ids the one with the lesser text, so repeated rows follow each other; an empty table gives
an empty result, and columns beside ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.common import WORD_GAP, text_or_empty

BIN_BITS = 7
BINS = 1 << BIN_BITS
SHINGLE = 5
#: Bins looked up before the whole order is searched.
PROBES = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Distinct-by-value use only: one 64-bit hash for each run of ``size`` words, in order."""

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
        return F.when(F.size(h) >= size, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _orders(bins: int) -> list[list[int]]:
    rng = random.Random(20240229)
    return [rng.sample(range(bins), bins) for _ in range(bins)]


def _bin(h: Column) -> Column:
    """The leading bits, by value: hashes sorted as signed numbers have their bins in order."""
    return F.shiftright(h, 64 - BIN_BITS).cast("int") + BINS // 2


def fingerprint(text: Column) -> Column:
    orders = _orders(BINS)
    # bins to try, by attempt: one literal array of all bins for each
    tries = [F.array(*(F.lit(orders[b][t]) for b in range(BINS))) for t in range(PROBES)]

    def densified(firsts: Column) -> Column:
        """``firsts``: the smallest hash of each bin that has one, in the order of the bins."""
        every = F.sequence(F.lit(0), F.lit(BINS - 1))
        held = let(F.map_from_arrays(F.transform(firsts, _bin), firsts), lambda table: F.transform(every, lambda b: F.try_element_at(table, b)))

        def fill(bins: Column) -> Column:
            def one(b: Column) -> Column:
                # beyond the probes: the bin of least hash with b, again fixed by b alone
                rest = F.array_min(F.transform(firsts, lambda h: F.struct(F.xxhash64(b, _bin(h)).alias("o"), h.alias("h"))))["h"]
                return F.coalesce(F.get(bins, b), *(F.get(bins, F.get(t, b)) for t in tries), rest)

            return F.transform(every, one)

        return let(held, fill)

    def digits(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda h: F.lower(F.hex(F.pmod(h, F.lit(16))))), "")

    def firsts_of(sorted_hashes: Column) -> Column:
        return F.filter(sorted_hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(sorted_hashes, i - 1))))

    found = let(F.sort_array(shingle_hashes(text)), firsts_of)
    return let(found, lambda x: F.when(F.size(x) == 0, F.lit("")).otherwise(digits(densified(x))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints (null if either is)."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0), lambda n, i: n + (F.substring(a, i, 1) == F.substring(b, i, 1)).cast("int"))
    raw = (same / F.lit(float(BINS)) - 1 / 16) / (1 - 1 / 16)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id, text, next_text`` in ascending doc_id (null first, repeated ones by text); after the last comes the first.

    Rows go to ``parts`` ranges of doc_id, whose bounds are quantiles (``parts`` numbers on
    the driver).  Each range also gets the rows that begin the following one, so that every
    row meets its follower in its own range, and none is sorted beyond it.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    quantiles = F.percentile_approx(key, F.lit([i / parts for i in range(1, parts)]), F.lit(100 * parts))
    r = docs.agg(F.min(key).alias("first"), quantiles.alias("q")).first()
    # a bound begins a range: the least key itself begins the first
    bounds = sorted({b for b in r["q"] or [] if b > r["first"]})
    array = F.array(*(F.lit(b) for b in bounds)) if bounds else F.array().cast("array<long>")
    rows = docs.select("doc_id", text_or_empty().alias("text"), key.alias("key"))
    rows = rows.withColumn("part", F.size(F.filter(array, lambda b: b <= F.col("key"))))
    begins = F.array_contains(array, F.col("key")) if bounds else F.lit(False)
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("extra"))
    ahead = F.when(begins, F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("extra")))
    wrap = F.when(F.col("key") == F.lit(r["first"]), F.struct(F.lit(len(bounds)).alias("part"), F.lit(2).alias("extra")))
    rows = rows.withColumn("to", F.explode(F.filter(F.array(own, ahead, wrap), lambda x: x.isNotNull()))).select("doc_id", "text", "key", "to.part", "to.extra")
    return rows.withColumn("next_text", F.lead("text").over(in_order()))


def in_order():
    return W.partitionBy("part").orderBy("extra", "key", "text")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, that of its edited form, and how alike it is to that and to the next one."""
    spark = docs.sparkSession
    rows = with_next(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", "key", "part", "extra", "text", n.cast("long").alias("n_chars"), F.when(F.col("extra") == 0, edited).alias("edited"))
    rows = rows.select("doc_id", "key", "part", "extra", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), F.when(F.col("extra") == 0, fingerprint(F.col("edited"))).alias("edited_fingerprint"))
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(in_order())).where("extra = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
