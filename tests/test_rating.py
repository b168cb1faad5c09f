import math

import pytest
from pyspark.sql import functions as F

from offerloom.functions import rating

NAN, INF = math.nan, math.inf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def num(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize(
    ("pay", "minutes", "miles", "want"),
    [(12.0, 20.0, 5.0, None), (0.5, 20.0, 5.0, "pay"), (301.0, None, None, "pay"), (12.0, 1.0, 5.0, "time"), (12.0, 241.0, 5.0, "time"), (12.0, 4.0, 6.0, "speed"), (12.0, 4.0, 0.9, None),
     (None, 1.0, 900.0, None), (12.0, None, 900.0, None), (12.0, 20.0, None, None), (NAN, 20.0, 5.0, "pay"), (12.0, NAN, 5.0, "time"), (12.0, 20.0, NAN, None), (12.0, 20.0, INF, None), (INF, 20.0, 1.0, "pay")],
)
def test_doubt(spark, pay, minutes, miles, want):
    assert one(spark, rating.doubt(num(pay), num(minutes), num(miles))) == want
    missing = pay is None or minutes is None
    assert one(spark, rating.suspect(num(pay), num(minutes), num(miles))) == (missing or want is not None)


def test_rate_long_hand(spark):
    r = rating.rate(num(14.0), num(25.0), num(8.0), num(6.0), cost_per_mile=num(0.3), pad=num(3.0), seconds_per_item=num(20.0), target=num(25.0))
    row = spark.range(1).select(*(v.alias(k) for k, v in r.items())).first()
    billed = 25 + 3 + 6 * 20 / 60
    assert row.billed_minutes == billed and row.net == pytest.approx(14 - 2.4) and row.per_hour == pytest.approx((14 - 2.4) / (billed / 60))
    assert row.gross_per_hour == pytest.approx(14 / (billed / 60)) and row.per_mile == pytest.approx((14 - 2.4) / 8) and row.state == "warn"


def test_states_and_missing_values(spark):
    state = lambda pay, minutes, miles=None, **s: one(spark, rating.rate(num(pay), num(minutes), num(miles), **s)["state"])
    assert [state(25.0, 60.0), state(21.25, 60.0), state(21.0, 60.0), state(None, 60.0), state(5.0, None), state(5.0, 0.0), state(500.0, 60.0)] == ["go", "warn", "no", "empty", "empty", "empty", "doubt"]
    assert state(25.0, 60.0, pad=num(-60.0)) == "empty" and state(24.0, 60.0, target=num(None)) == "warn"
    late = rating.rate(num(10.0), num(None), num(3.0), deliver_by=F.lit(15), now_minutes=F.lit(1430))
    assert one(spark, late["card_minutes"]) == 25 and one(spark, late["from_deadline"])
    far = rating.rate(num(20.0), num(30.0), num(30.0), uncertain=F.lit(True), cost_per_mile=num(1.0))
    assert one(spark, far["cost"]) == 0 and one(spark, far["per_mile"]) is None


def test_rounding_and_settings(spark):
    assert [one(spark, rating.round2(num(x))) for x in (0.145, 2.675, 1.005, -1.005, None)] == [0.14, 2.68, 1.0, -1.0, None]
    value = lambda j: one(spark, rating.setting(F.try_parse_json(F.lit(j)), num(25.0)))
    assert [value(j) for j in ("30", '"30.5"', "0", "true", "null", '""', '"1e3"', "[1]", "2.5")] == [30, 30.5, 0, 25, 25, 25, 25, 25, 2.5]


def test_distance(spark):
    got = lambda m, d, dec: tuple(one(spark, rating.check_distance(num(m), num(d), F.lit(dec))))
    assert got(30.0, 20.0, False) == (20, False, False) and got(30.0, 36.0, False) == (3.6, True, False)
    assert got(30.0, 36.0, True) == (36, False, False) and got(30.0, 40.0, True) == (40, False, True) and got(None, 40.0, True) == (40, False, False)
