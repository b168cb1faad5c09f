"""Columns that judge a reading: plausibility, money per hour, verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speeds in miles an hour, and the bounds of a believable offer.
MOST_MPH, UNREADABLE_MPH, LEAST_MPH = 55, 75, 0.5
PAY_RANGE, MINUTES_RANGE = (1, 300), (2, 240)
DEFAULTS = {"target": 25.0, "band": 15.0, "cost_per_mile": 0.0, "pad": 0.0, "seconds_per_item": 0.0}


def finite(x: Column) -> Column:
    """``x``, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def round2(x: Column) -> Column:
    """To cents, halves up, as ``floor(100x + 1/2) / 100`` in binary arithmetic."""
    return F.floor(x * 100 + 0.5) / 100


def mph(miles: Column, minutes: Column) -> Column:
    return F.try_divide(miles, minutes / 60)


def recover_decimal(minutes: Column, miles: Column, had_decimal: Column) -> Column:
    """``struct<miles,corrected>`` of one leg: a tenth, where only a lost point explains the speed."""
    tenth = miles / 10
    lost = ~had_decimal & (minutes != 0) & (mph(miles, minutes) > MOST_MPH) & mph(tenth, minutes).between(LEAST_MPH, MOST_MPH)
    lost = F.coalesce(lost, F.lit(False))
    return F.struct(F.when(lost, tenth).otherwise(miles).alias("miles"), lost.alias("corrected"))


def check_distance(minutes: Column, miles: Column, had_decimal: Column) -> Column:
    """``struct<miles,corrected,uncertain>`` of a whole journey."""
    speed = F.when(minutes > 0, mph(miles, minutes))
    lost = F.coalesce(~had_decimal & (speed > MOST_MPH) & (speed / 10).between(LEAST_MPH, MOST_MPH), F.lit(False))
    return F.struct(
        F.when(lost, miles / 10).otherwise(miles).alias("miles"), lost.alias("corrected"),
        (~lost & F.coalesce(speed > UNREADABLE_MPH, F.lit(False))).alias("uncertain"),
    )


def is_complete(pay: Column, minutes: Column, deliver_by: Column) -> Column:
    return F.coalesce(pay > 0, F.lit(False)) & (F.coalesce(minutes > 0, F.lit(False)) | deliver_by.isNotNull())


def is_whole(complete: Column, has_total: Column, leg_detail: Column, legs: Column, deliver_by: Column, miles: Column) -> Column:
    """Whether another frame could add nothing."""
    n = F.coalesce(legs, F.lit(0))
    any_total = F.coalesce(F.exists(leg_detail, lambda x: F.coalesce(x["is_total"], F.lit(False))), F.lit(False))
    done = F.coalesce(has_total, F.lit(False)) | any_total | (n >= 2) | ((n == 0) & deliver_by.isNotNull() & miles.isNotNull())
    return F.coalesce(complete, F.lit(False)) & done


def doubt(pay: Column, minutes: Column, miles: Column) -> Column:
    """``pay``, ``time`` or ``speed``: the first bound that a reading breaks; null if none.

    A missing value ends the questions that follow it.  Infinite miles are no miles.
    """
    within = lambda x, r: ~F.isnan(x) & x.between(*r)
    far = finite(miles)
    return (
        F.when(pay.isNull(), None).when(~within(pay, PAY_RANGE), "pay").when(minutes.isNull(), None)
        .when(~within(minutes, MINUTES_RANGE), "time").when((far >= 1) & (mph(far, minutes) > UNREADABLE_MPH), "speed")
    )


def suspect(pay: Column, minutes: Column, miles: Column) -> Column:
    """As ``doubt``, but what is missing counts as broken."""
    return pay.isNull() | minutes.isNull() | doubt(pay, minutes, miles).isNotNull()


def minutes_until(deadline: Column, now_minutes: Column) -> Column:
    left = deadline - finite(now_minutes.cast("double"))
    return F.when(left < 0, left + 1440).otherwise(left)


def clock_minutes(at: Column, trusted_from: str = "2025-01-01") -> Column:
    """Minutes after midnight; null while the clock can't have been set yet."""
    return F.when(at >= F.lit(trusted_from).cast("timestamp"), F.hour(at) * 60 + F.minute(at))


def setting(value: Column, fallback: Column) -> Column:
    """A variant setting as a number: numbers and strings that spell one; anything else gives the fallback."""
    kind = F.schema_of_variant(value)
    text = F.trim(F.try_variant_get(value, "$", "string"))
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(value, "$", "double"))
    spelt = F.when((kind == "STRING") & text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.try_cast("double"))
    return F.coalesce(finite(F.coalesce(number, spelt)), fallback)


def rate(
    pay: Column, minutes: Column, miles: Column, items: Column | None = None, deliver_by: Column | None = None,
    uncertain: Column | None = None, now_minutes: Column | None = None, **settings: Column,
) -> dict[str, Column]:
    """What an offer earns, by name; ``state`` is empty, doubt, go, warn or no."""
    given = {k: F.coalesce(finite(settings.get(k, F.lit(v))), F.lit(v)) for k, v in DEFAULTS.items()}
    null = F.lit(None)
    items = F.lit(0.0) if items is None else items
    uncertain = F.lit(False) if uncertain is None else F.coalesce(uncertain, F.lit(False))
    left = null.cast("double") if deliver_by is None else minutes_until(deliver_by, null if now_minutes is None else now_minutes)
    card = F.coalesce(F.when(minutes > 0, minutes), left)
    shop = F.coalesce(items, F.lit(0.0)) * given["seconds_per_item"] / 60
    billed = card + given["pad"] + shop
    ready = F.coalesce((pay > 0) & (card > 0) & (billed > 0), F.lit(False))
    when = lambda x: F.when(ready, x)
    cost = F.when(uncertain, 0.0).otherwise(F.coalesce(miles, F.lit(0.0)) * given["cost_per_mile"])
    net = pay - cost
    hours = billed / 60
    per_hour = F.try_divide(net, hours)
    reason = doubt(pay, card, miles)
    verdict = F.when(per_hour >= given["target"], "go").when(per_hour >= given["target"] * (1 - given["band"] / 100), "warn").otherwise("no")
    return {
        "ready": ready, "card_minutes": card, "shop_minutes": when(shop), "billed_minutes": when(billed), "cost": when(cost), "net": when(net),
        "per_hour": when(per_hour), "gross_per_hour": when(F.try_divide(pay, hours)), "per_min": when(F.try_divide(net, billed)),
        "per_mile": when(F.when(~uncertain & (miles != 0), F.try_divide(net, miles))), "from_deadline": when(F.coalesce(~(minutes > 0), F.lit(True))),
        "doubt": when(reason), "state": F.when(~ready, "empty").when(reason.isNotNull(), "doubt").otherwise(verdict),
    }


def clamp_int(raw: Column, low: int, high: int, fallback: int) -> Column:
    """The whole number that a text begins with, within bounds; the fallback if it begins with none."""
    digits = F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1)
    n = F.when(digits != "", digits.cast("double"))
    return F.when(n.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), n))).otherwise(fallback).cast("long")


def typed(text: Column) -> Column:
    """The number that a typed field begins with; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def calculate(pay: Column, minutes: Column, miles: Column, target: Column, band: Column, cost_per_mile: Column, pad: Column) -> dict[str, Column]:
    """The verdict on figures typed by hand, by name; ``minutes`` are padded, but none typed is no offer."""
    pay, timed, miles = typed(pay), typed(minutes), typed(miles)
    padded = timed + pad
    ready = (pay > 0) & (timed > 0) & (padded > 0)
    cost = miles * cost_per_mile
    net = pay - cost
    per_hour = F.when(ready, F.try_divide(net, padded / 60))
    some = lambda x: F.when(x > 0, x)
    reason = doubt(some(pay), some(timed), some(miles))
    verdict = F.when(reason.isNotNull(), "doubt").when(per_hour >= target, "go").when(per_hour >= target * (1 - band / 100), "warn").otherwise("no")
    return {
        "ready": ready, "pay": pay, "miles": miles, "minutes": padded, "typed_minutes": timed, "cost": cost, "net": net, "per_hour": per_hour, "per_min": F.when(ready, F.try_divide(net, padded)),
        "per_mile": F.when((pay > 0) & (miles > 0), F.try_divide(net, miles)), "doubt": reason, "state": F.when(per_hour.isNull(), "empty").otherwise(verdict),
    }
