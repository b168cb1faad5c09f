"""The journal's read model: vote, annotate, window, hide, count, cap.

Readings of an offer vote by window counts over their id, which needs one shuffle by id and
no pairs of readings.  Marks and rules are folded to one row for a key before they are
joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions.rating import doubt, finite, suspect

DAY_MS = 86_400_000


def same_value(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def vote(readings: DataFrame, key: tuple[str, ...] = ("rig", "id")) -> DataFrame:
    """The best-supported reading of each offer, later rows winning ties.

    A reading earns 3 for each sibling with the same pay, 2 for the same minutes and 2 for
    the same known miles; it loses 1000 if it is suspect, 100 if it isn't whole, and 3 if
    it lacks miles that a sibling has.
    """
    by = [F.col(k) for k in key]
    alike = lambda *c: F.count("*").over(W.partitionBy(*by, *c)) - 1
    known = F.col("miles").isNotNull()
    others_know = F.max(known.cast("int")).over(W.partitionBy(*by)) == 1
    score = 3 * alike("pay") + 2 * alike("minutes") + F.when(known, 2 * alike("miles")).otherwise(F.when(others_know, -3).otherwise(0))
    score = score - F.when(F.coalesce("suspect", F.lit(False)), 1000).otherwise(0) - F.when(F.col("whole").eqNullSafe(False), 100).otherwise(0)
    scored = readings.withColumn("score", score.cast("long"))
    rest = [c for c in scored.columns if c not in key]
    best = scored.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("score", "ord")).alias("r"), F.min("ord").alias("first_ord"), F.count("*").alias("readings"))
    return best.select(*key, "r.*", "first_ord", "readings")


def consensus(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the largest among equals."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("count", value)).alias(value), F.max("count").alias("votes"))


def fold_marks(marks: DataFrame) -> DataFrame:
    """The last given ``accepted`` and ``hidden`` of each rig's id, each field on its own."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"mark_{c}")
    return marks.where("id IS NOT NULL").groupBy("rig", "id").agg(last("accepted"), last("hidden"))


def fold_rules(rules: DataFrame) -> DataFrame:
    """The last ``hidden`` of each rig's (pay, minutes, miles), where missing miles are a value."""
    known = rules.where("hidden IS NOT NULL")
    return known.groupBy("rig", "pay", "minutes", "miles").agg(F.max_by("hidden", "ord").alias("rule_hidden"))


def annotate(offers: DataFrame, marks: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules by what an offer says, then marks by its id, which win."""
    m = fold_marks(marks).withColumnsRenamed({"rig": "mark_rig", "id": "mark_id"})
    key = ("rig", "pay", "minutes", "miles")
    r = fold_rules(rules).select(*(F.col(c).alias(f"rule_{c}") for c in key), "rule_hidden")
    same = [F.col(c).eqNullSafe(F.col(f"rule_{c}")) for c in key]
    out = offers.join(r, same, "left").join(m, (F.col("rig") == F.col("mark_rig")) & (F.col("id") == F.col("mark_id")), "left")
    out = out.withColumn("hidden", F.coalesce("mark_hidden", "rule_hidden", "hidden")).withColumn("accepted", F.coalesce("mark_accepted", "accepted"))
    return out.select(*offers.columns)


def latest(readings: DataFrame, marks: DataFrame, rules: DataFrame) -> DataFrame:
    """One annotated row for each offer; order by ``coalesce(seen_ms, 0), first_ord``."""
    return annotate(vote(readings), marks, rules)


def window(offers: DataFrame, floor_ms: Column) -> DataFrame:
    """Offers from ``floor_ms`` on; a row without a time counts as time 0."""
    return offers.where(F.coalesce("seen_ms", F.lit(0)) >= floor_ms)


def hidden_counts(offers: DataFrame, by: list[str]) -> DataFrame:
    """Offers in the window, and how many of them are hidden, before hidden ones go."""
    gone = F.coalesce("hidden", F.lit(False))
    return offers.groupBy(*by).agg(F.count("*").alias("in_window"), F.count_if(gone).alias("hidden_rows"), F.count_if(~gone).alias("total"))


def visible(offers: DataFrame) -> DataFrame:
    return offers.where(~F.coalesce("hidden", F.lit(False)))


def tail(offers: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows in time order (all for 0), for each rig."""
    if not n:
        return offers
    newest = W.partitionBy("rig").orderBy(F.desc(F.coalesce("seen_ms", F.lit(0))), F.desc("first_ord"))
    return offers.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n).drop("_nth")


def iso_time(ms: Column) -> Column:
    """UTC time of epoch milliseconds as text; empty beyond what a date can hold."""
    ok = ms.between(-8_640_000_000_000_000, 8_640_000_000_000_000) & ms.between(-62_135_596_800_000, 253_402_300_799_999)
    return F.when(ok, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("")


def plain_number(c: Column) -> Column:
    """A double in the fewest digits that tell it (15 at least, less trailing zeros), without an exponent from 1e-6 up
    to 1e21; beyond that as 5e-7 or 1e+21."""
    size, short = F.abs(c), c.cast("string")
    usual = ~F.contains(short, F.lit("E")) & (F.length(short) <= 16)
    spelled = [F.format_string(f"%.{n}e", c) for n in (14, 15, 16)]
    said = F.coalesce(*(F.when(x.cast("double") == c, x) for x in spelled[:2]), spelled[2])
    digits = lambda scale: F.regexp_replace(said.cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")
    far = F.regexp_replace(F.regexp_replace(said, r"\.?0*e", "e"), r"e([+-])0*(\d)", "e$1$2")
    return (
        F.when(c == 0, "0").when(usual, F.regexp_replace(short, r"\.0$", "")).when((size < 1e-6) | (size >= 1e21), far)
        .when(c == F.floor(c), said.cast("decimal(38,0)").cast("string")).when(size < 1, digits(24)).otherwise(digits(16))
    )


def csv_cell(c: Column, kind: str) -> Column:
    """A cell of a line: empty for null, 1 or 0 for a flag, a bare number, a joined list, a quoted text."""
    if kind == "boolean":
        cell = F.when(c, "1").otherwise("0")
    elif kind.startswith("array"):
        cell = quoted(F.array_join(c, "; "))
    elif kind == "string":
        cell = quoted(c)
    elif kind == "double":
        cell = plain_number(c)
    else:
        cell = c.cast("string")
    return F.when(c.isNull(), "").otherwise(cell)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


# The columns of an export, in their order; the row's time in words follows.
CSV_COLUMNS = (
    "at", "pay", "minutes", "billedMinutes", "miles", "items", "perHour", "grossPerHour", "perMile", "cost", "state", "target", "band", "costPerMile", "legs",
    "mergedFrom", "hasTotal", "shop", "milesCorrected", "milesUncertain", "whole", "settled", "suspect", "doubt", "accepted", "hidden", "places", "deliverBy", "fromDeadline", "ms",
)


def csv_header(columns: tuple[str, ...] = CSV_COLUMNS) -> str:
    return ",".join([*columns, "when"])


def csv_lines(rows: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS, at: str = "seen_ms") -> DataFrame:
    """``line``: the given columns, and the row's time in words, as one CSV line each."""
    kinds, seen_ms = dict(rows.dtypes), F.col(at)
    return rows.withColumn("line", F.concat_ws(",", *(csv_cell(F.col(c), kinds[c]) for c in columns), quoted(iso_time(F.coalesce(seen_ms, F.lit(0))))))


def newest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Newest offer's time, offers and rows; annotations count as rows only."""
    offer = F.col("kind") == "offer"
    return rows.groupBy(*by).agg(F.max(F.when(offer, F.col("seen_ms"))).alias("newest_ms"), F.count_if(offer).alias("offers"), F.count("*").alias("rows"))


def last_offer(rows: DataFrame, by: list[str], kind: str = "kind", order: str = "ord") -> DataFrame:
    """The newest row of each of ``by`` that is an offer: one without a kind."""
    rest = [c for c in rows.columns if c not in by]
    return rows.where(F.col(kind).isNull()).groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*by, "r.*")


def freshest(files: DataFrame) -> DataFrame:
    """The file written last (the first by name among equals) of ``path, mtime``."""
    return files.orderBy(F.desc("mtime"), "path").limit(1)


def response(offers: DataFrame, floor_ms: Column, limit: int, show_hidden: bool = False) -> DataFrame:
    """What a page asks for, one row for each rig: ``count, total, truncated, hidden, offers``.

    A rig's offers are one value, so ``limit`` or ``floor_ms`` bounds it: a rig writes about 19 MB a year, and a value
    holds 2 GB; ``window``, ``visible`` and ``tail`` give the same offers as rows.  ``hidden`` and ``total`` are counted before the cut to the newest ``limit`` offers (0: all), which
    stand in time order.
    """
    inside = window(offers, floor_ms)
    counts = hidden_counts(inside, ["rig"])
    shown = inside if show_hidden else visible(inside)
    order = F.struct(F.coalesce("seen_ms", F.lit(0)).alias("t"), F.col("first_ord").alias("n"))
    listed = tail(shown, limit).groupBy("rig").agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), F.struct(*offers.columns).alias("offer")))).alias("found"))
    total = F.col("in_window") if show_hidden else F.col("total")
    out = counts.join(listed, "rig", "left").withColumn("offers", F.coalesce(F.transform("found", lambda x: x["offer"]), F.array()))
    return out.select("rig", F.size("offers").alias("count"), total.alias("total"), (total > F.size("offers")).alias("truncated"), F.col("hidden_rows").alias("hidden"), "offers")


def python_round(x: Column, places: int) -> Column:
    """``x`` to so many decimals as binary arithmetic is rounded exactly: halves to the even digit.

    A function of arrays, not of their iterator: all figures of a row then share one Python worker.
    """

    unit = 10.0**places

    @F.arrow_udf("double")
    def rounded(values: pa.Array) -> pa.Array:
        x, known = values.to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = x * unit
            out = np.rint(scaled) / unit
            # near a half, or too large for whole steps, the number itself decides
            odd = ~(np.abs(scaled - np.floor(scaled) - 0.5) > 1e-6) | ~(np.abs(scaled) < 2**40)
        for i in np.flatnonzero(odd & known):
            out[i] = round(float(x[i]), places)
        return pa.array(out, pa.float64(), mask=~known)

    return rounded(x.cast("double"))


def offer_id(at_ms: Column, pay: Column) -> Column:
    """``time-cents``; x for a pay that wasn't read."""
    return F.concat(at_ms.cast("string"), F.lit("-"), F.coalesce(F.bround(pay * 100, 0).cast("long").cast("string"), F.lit("x")))


def journal_rows(readings: DataFrame) -> DataFrame:
    """Rows as the journal keeps them, from judged readings.

    Expects the columns of ``text.parse`` and ``rating.rate``, the settings ``target, band,
    cost_per_mile``, and ``first_ms, seen_ms, seq, ms, locked, settled, whole``.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    minutes = F.coalesce("card_minutes", "minutes")
    figures = (F.col("pay"), minutes, F.col("miles"))
    first = F.coalesce("first_ms", "seen_ms")
    r2 = lambda c: python_round(F.col(c), 2)
    row = {
        "v": F.lit(1), "id": offer_id(first, F.col("pay")), "seq": F.col("seq"), "at": F.col("seen_ms"), "firstAt": first, "pay": F.col("pay"), "minutes": minutes, "miles": F.col("miles"),
        "items": F.col("items"), "shop": F.when(F.col("shop"), F.lit(True)), "perHour": r2("per_hour"), "grossPerHour": r2("gross_per_hour"), "perMile": r2("per_mile"), "cost": r2("cost"),
        "billedMinutes": python_round(F.col("billed_minutes"), 1), "state": F.col("state"), "target": F.col("target"), "band": F.col("band"), "costPerMile": F.col("cost_per_mile"),
        "legs": F.col("legs"), "mergedFrom": F.col("merged_from"), "hasTotal": flag("has_total"), "milesCorrected": flag("miles_corrected"), "milesUncertain": flag("miles_uncertain"),
        "locked": flag("locked"), "whole": flag("whole"), "settled": flag("settled"), "suspect": suspect(*figures), "doubt": doubt(*figures), "places": F.coalesce("places", F.array().cast("array<string>")),
        "deliverBy": F.col("deliver_by"), "fromDeadline": flag("from_deadline"), "ms": F.bround("ms", 0).cast("long"),
    }
    keys = [c for c in ("rig", "ord") if c in readings.columns]
    return readings.select(*keys, *(c.alias(n) for n, c in row.items()))


def writable(readings: DataFrame) -> DataFrame:
    """Readings that the journal takes: ready and locked."""
    return readings.where("ready AND locked")


def live_rows(readings: DataFrame) -> DataFrame:
    """What a page is told of each reading, figures rounded, text cut; ``live_lines`` makes it JSON."""
    ready = lambda c, n=2: python_round(F.when(F.col("ready"), F.col(c)), n)
    keys = [c for c in ("rig", "ord") if c in readings.columns]
    same = ("ready", "locked", "state", "doubt", "pay", "minutes", "miles", "items", "legs", "whole")
    return readings.select(
        *keys, *same, ready("per_hour").alias("perHour"), ready("gross_per_hour").alias("grossPerHour"), ready("billed_minutes", 1).alias("billedMinutes"), python_round(F.col("per_mile"), 2).alias("perMile"),
        ready("cost").alias("cost"), F.col("card_minutes").alias("cardMinutes"), F.coalesce("from_deadline", F.lit(False)).alias("fromDeadline"), F.col("deliver_by").alias("deliverBy"),
        F.coalesce("places", F.array().cast("array<string>")).alias("places"), F.coalesce("merged_from", F.lit(1)).alias("mergedFrom"), F.bround("ms", 0).cast("long").alias("ms"),
        F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("text"),
    )


def live_lines(readings: DataFrame) -> DataFrame:
    rows = live_rows(readings)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def note_of(body: Column) -> Column:
    """``struct<kind,id,pay,minutes,miles,accepted,hidden,error>`` of a request (VARIANT) to mark an offer or make a rule.

    A mark names an id of 1 to 79 characters, else a rule a pay and a time; either says whether
    an offer is accepted or hidden.  Fields of another type than theirs count as absent.
    """
    of = lambda path, kind, said: F.when(F.schema_of_variant(F.try_variant_get(body, path, "variant")).rlike(said), F.try_variant_get(body, path, kind))
    number = lambda name: finite(of(f"$.match.{name}", "double", "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"))
    ident = of("$.id", "string", "^STRING$")
    ident = F.when(F.length(ident).between(1, 79), ident)
    is_rule = ident.isNull() & F.schema_of_variant(F.try_variant_get(body, "$.match", "variant")).rlike("^(OBJECT|ARRAY)")
    pay, minutes, miles = (F.when(is_rule, number(n)) for n in ("pay", "minutes", "miles"))
    accepted, hidden = (of(f"$.{n}", "boolean", "^BOOLEAN$") for n in ("accepted", "hidden"))
    kind = F.when(ident.isNotNull(), "mark").when(is_rule, "rule")
    error = (
        F.when(~F.coalesce(F.schema_of_variant(body).rlike("^OBJECT"), F.lit(False)), "bad body").when(kind.isNull(), "no offer named")
        .when((kind == "rule") & (pay.isNull() | minutes.isNull()), "a rule needs a pay and a time").when(accepted.isNull() & hidden.isNull(), "nothing to note")
    )
    return F.struct(kind.alias("kind"), ident.alias("id"), pay.alias("pay"), minutes.alias("minutes"), miles.alias("miles"), accepted.alias("accepted"), hidden.alias("hidden"), error.alias("error"))
