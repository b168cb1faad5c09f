"""Columns that read an offer card's text: pay, legs, items, deadline, places.

Everything is built-in expressions, so parsing stays in the JVM and needs no shuffle.
Text comes from a camera; digits may be misread as letters, and a value that can't be read
is null rather than a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.rating import check_distance, is_complete, recover_decimal, round2

# Characters misread for digits, and the forms in which cards print amounts,
# durations, distances, deadlines and places.  Word boundaries are ASCII ones.
LOOKALIKES = ("OoQDlIi|!SsBbZzgGT", "000011111558622967")
NUMERIC = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
_D = "[\\dOoQlIiSsBbZz]"
_B = "(?<![A-Za-z0-9_])"  # a word begins
_E = "(?![A-Za-z0-9_])"  # a word ends
MONEY_STRICT = rf"\$\s*({_D}{{1,4}}(?:[.,]{_D}{{1,2}})?)"
MONEY_LOOSE = rf"(?:^|[\s(])[$S5§]\s?({_D}{{1,4}}[.,]{_D}{{2}})"
LEG = (
    rf"(?i)(?:(\d{{1,2}})\s*h(?:r|rs|our|ours)?\s*)?({_D}{{1,3}})\s*m[il1|]n(?:s|ute|utes)?{_E}"
    rf"(?:[^(\d]{{0,6}}\(?\s*({_D}{{1,3}}(?:[.,]{_D}{{1,2}})?)\s*m(?:i|ile|iles){_E}\s*\)?)?"
)
ITEMS = rf"(?i)({_D}{{1,3}})\s*items?{_E}"
DELIVER_BY = r"(?i)deliver(?:ed|y)?\s*by\s*(\d{1,2})\s*[:.]\s*(\d{2})\s*([ap])\.?\s*m\.?"
LONE_MILES = rf"(?i)(?:^|[^\d.])({_D}{{1,3}}(?:[.,]{_D}{{1,2}})?)\s*mi(?:les?)?{_E}(?!\s*from)"
SHOP_CARD = rf"(?i){_B}shop{_E}[\s&+]*(?:and\s*)?{_B}deliver"
PICKUP = (
    rf"(?is){_B}pick\s?up{_E}[\s:.-]*(.{{2,60}}?)(?=\s*\(\s*\d+\s*orders?\s*\)|\s+customer{_E}|\s+dropoff{_E}"
    rf"|\s+accept{_E}|\s+add\s+to{_E}|\s+decline{_E}|$)"
)
PLACE = (
    rf"(?is)^[A-Za-z].*(?:,\s*[A-Za-z]|\s&\s|{_B}(?:st|street|rd|road|ave|avenue|blvd|pkwy|parkway|dr|drive|ln|lane|way"
    rf"|ct|court|hwy|highway|pl|place|ter|terrace|cir|circle){_E})"
)
PLACE_JUNK = (
    rf"(?i)^(?:pickup|dropoff|customer|accept|decline|add\s+to\s+route|deliver(?:ed|y)?\s*by.*|verified|exclusive"
    rf"|guaranteed){_E}[\s:.-]*"
)
PLACE_STOP = rf"(?i){_B}(?:accept|decline|verified|exclusive|guaranteed|add\s+to\s+route|\d+\s*mi{_E})"
DEADLINE_STOP = rf"(?i)\d|{_B}(?:accept|decline|pickup|customer|dropoff){_E}"
MOST_PAY, MOST_MINUTES, MOST_MILES, MOST_ITEMS, MOST_PLACES = 2000, 600, 500, 200, 4


def normalize(text: Column) -> Column:
    """One line with plain quotes, dashes and single spaces; null reads as empty."""
    t = F.coalesce(text, F.lit(""))
    t = F.translate(t, "‘’“”–—− ", "''''--- ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def fix_digits(token: Column) -> Column:
    return F.translate(token, *LOOKALIKES)


def to_number(token: Column) -> Column:
    """The number a whole token spells after lookalikes are mended; null if it is more or less than a number."""
    t = F.trim(F.regexp_replace(fix_digits(token), "^([^,]*),", "$1."))
    return F.when(t.rlike(NUMERIC), t.try_cast("double"))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without one."""
    return F.get(_all(text, pattern, group), 0)


def find_pay(text: Column) -> Column:
    """The largest believable amount with a dollar sign, or else one with a lookalike of it and cents."""
    strict = _all(text, MONEY_STRICT, 1)
    found = F.when(F.size(strict) > 0, strict).otherwise(_all(text, MONEY_LOOSE, 1))
    return F.array_max(F.filter(F.transform(found, to_number), lambda v: (v > 0) & (v < MOST_PAY)))


def leg_matches(whole: Column, gaps: Column) -> Column:
    """Every leg-like match (``whole``, between the texts ``gaps``): ``minutes, miles, had_decimal, is_total, corrected, kept``.

    The pattern has run over the text once; its parts are taken from the short matches.
    """
    # 14 characters hold four matches at most
    pieces = lambda i: (F.coalesce(F.get(x, i + k), F.lit("")) for k in range(1, 5) for x in (gaps, whole))
    following = lambda i: F.substring(F.concat(*pieces(i)), 1, 14)
    parts = F.transform(whole, lambda m, i: F.struct(*(F.regexp_extract(m, LEG, g).alias(n) for g, n in ((1, "hours"), (2, "mins"), (3, "dist"))), following(i).alias("ahead")))

    def leg(m: Column) -> Column:
        mins = to_number(m["mins"])
        minutes = F.coalesce(to_number(m["hours"]), F.lit(0.0)) * 60 + mins
        raw = to_number(m["dist"])
        miles = F.when((raw >= 0) & (raw <= MOST_MILES), raw)
        decimal = m["dist"].rlike("[.,]")
        fixed = recover_decimal(minutes, miles, decimal)
        kept = mins.isNotNull() & m["mins"].rlike(r"\d") & (minutes > 0) & (minutes <= MOST_MINUTES)
        return F.struct(
            minutes.alias("minutes"), fixed["miles"].alias("miles"), (decimal | fixed["corrected"]).alias("had_decimal"),
            m["ahead"].rlike(f"(?i){_B}tota?l{_E}").alias("is_total"), fixed["corrected"].alias("corrected"), F.coalesce(kept, F.lit(False)).alias("kept"),
        )

    return F.transform(parts, leg)


def cut(text: Column) -> tuple[Column, Column]:
    """The text's leg-like matches and the texts between them."""
    return _all(text, LEG, 0), F.split(text, LEG, -1)


def find_legs(text: Column) -> Column:
    """``array<struct<minutes,miles,had_decimal,is_total,corrected>>`` in the order of the text."""
    return kept_legs(leg_matches(*cut(text)))


def kept_legs(matches: Column) -> Column:
    kept = F.filter(matches, lambda x: x["kept"])
    names = ("minutes", "miles", "had_decimal", "is_total", "corrected")
    return F.transform(kept, lambda x: F.struct(*(x[n].alias(n) for n in names)))


def find_items(text: Column) -> Column:
    n = to_number(_first(text, ITEMS, 1))
    return F.when((n >= 0) & (n <= MOST_ITEMS), n)


def lone_miles(text: Column) -> Column:
    n = to_number(_first(text, LONE_MILES, 1))
    return F.when((n > 0) & (n <= MOST_MILES), round2(n))


def find_deadline(text: Column) -> Column:
    """Minutes after midnight of "Deliver by h:mm AM/PM"."""
    found = _first(text, DELIVER_BY, 0)
    hour, minute, half = (F.nullif(F.regexp_extract(found, DELIVER_BY, g), F.lit("")) for g in (1, 2, 3))
    hour, minute = hour.cast("int"), minute.cast("int")
    at = hour % 12 * 60 + minute + F.when(F.lower(half) == "p", 720).otherwise(0)
    return F.when((hour >= 1) & (hour <= 12) & (minute <= 59), at)


def find_shop(text: Column) -> Column:
    return F.when(text.rlike(SHOP_CARD), F.lit(True))


def _strip(value: Column, more: str = "") -> Column:
    marks = rf"[\s.,\-;:|{more}]+"
    return F.regexp_replace(value, rf"^{marks}|{marks}$", "")


def find_places(text: Column) -> Column:
    """Up to four places the card names: behind "Pickup", behind the deadline, and behind each leg."""
    whole, gaps = cut(text)
    return named_places(text, leg_matches(whole, gaps), whole, gaps)


def named_places(text: Column, matches: Column, whole: Column, gaps: Column) -> Column:

    # text between a kept leg and the next kept one; a match that isn't kept is text like any other
    def grow(tails: Column, i: Column) -> Column:
        gap = F.get(gaps, i + 1)
        last = F.concat(F.element_at(tails, -1), F.get(whole, i), gap)
        longer = F.concat(F.slice(tails, 1, F.greatest(F.size(tails) - 1, F.lit(0))), F.array(last))
        return F.when(F.get(matches, i)["kept"], F.concat(tails, F.array(gap))).when(F.size(tails) > 0, longer).otherwise(tails)

    indices = F.when(F.size(whole) > 0, F.sequence(F.lit(0), F.size(whole) - 1)).otherwise(F.array().cast("array<int>"))
    tails = F.aggregate(indices, F.array().cast("array<string>"), grow)
    near = F.transform(tails, lambda t: _strip(F.get(F.split(F.substring(t, 1, 80), PLACE_STOP, -1), 0), "()"))
    near = F.filter(near, lambda t: t.rlike(PLACE))
    after = F.get(F.split(_first(text, f"{DELIVER_BY}(.{{0,60}})", 4), DEADLINE_STOP, -1), 0)
    named = F.concat(F.array(_first(text, PICKUP, 1), after), near)
    clean = F.transform(named, lambda v: _strip(F.regexp_replace(v, PLACE_JUNK, "")))
    clean = F.filter(clean, lambda v: F.length(v).between(3, 60) & v.rlike("[A-Za-z]{2}"))
    seen = lambda out, v: F.exists(out, lambda o: F.lower(o) == F.lower(v))
    once = F.aggregate(clean, F.array().cast("array<string>"), lambda out, v: F.when(seen(out, v), out).otherwise(F.concat(out, F.array(v))))
    return F.slice(once, 1, MOST_PLACES)


def _sum(values: Column) -> Column:
    """Sum in order; null without values."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))


def parse(df, text: str = "text"):
    """``df`` with the reading of each card: pay, minutes, miles, deliver_by, places, leg_detail,
    items, legs, miles_corrected, miles_uncertain, complete, shop and the normalised text.

    Intermediate columns are projected once, so no pattern runs more often than it must.
    """
    df = df.withColumn(text, normalize(F.col(text)))
    t = F.col(text)
    whole, gaps = cut(t)
    df = df.withColumns({"_whole": whole, "_gaps": gaps})
    df = df.withColumn("_matches", leg_matches(F.col("_whole"), F.col("_gaps"))).withColumn("_legs", kept_legs(F.col("_matches")))
    places = named_places(t, F.col("_matches"), F.col("_whole"), F.col("_gaps"))
    totals = F.filter("_legs", lambda x: x["is_total"])
    df = df.withColumn("_used", F.when(F.size(totals) > 0, totals).otherwise(F.col("_legs")))
    far = F.filter("_used", lambda x: x["miles"].isNotNull())
    df = df.withColumn("_minutes", _sum(F.transform("_used", lambda x: x["minutes"]))).withColumn("_far", far)
    df = df.withColumn("_miles", round2(_sum(F.transform("_far", lambda x: x["miles"]))))
    df = df.withColumn("_dist", check_distance(F.col("_minutes"), F.col("_miles"), F.exists("_far", lambda x: x["had_decimal"])))
    alone = F.when(F.size("_used") == 0, lone_miles(t))
    df = df.withColumns({"pay": find_pay(t), "minutes": F.col("_minutes"), "miles": F.coalesce("_dist.miles", alone), "deliver_by": find_deadline(t), "places": places, "items": find_items(t), "shop": find_shop(t)})
    return df.withColumns({
        "leg_detail": F.transform("_used", lambda x: F.struct(x["minutes"].alias("minutes"), x["miles"].alias("miles"), x["is_total"].alias("is_total"))),
        "legs": F.size("_used"),
        "miles_corrected": F.col("_dist.corrected") | F.exists("_far", lambda x: x["corrected"]),
        "miles_uncertain": F.col("_dist.uncertain"),
        "complete": is_complete(F.col("pay"), F.col("minutes"), F.col("deliver_by")),
    }).drop("_whole", "_gaps", "_matches", "_legs", "_used", "_minutes", "_far", "_miles", "_dist")
