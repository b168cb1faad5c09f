"""Card texts of our own making, each with the reading it should give."""

import pytest
from pyspark.sql import functions as F

from offerloom.functions import rating, text

CARDS = [
    ("$9.25 4 min (0.8 mi) away 17 min (6.4 mi) trip", dict(pay=9.25, minutes=21, miles=7.2, legs=2, complete=True, shop=None)),
    ("S9.2S l7 min (6,4 mi) total", dict(pay=9.25, minutes=17, miles=6.4, legs=1)),
    ("$3.00 promo $14.50 1 hr 5 mins (22.0 miles)", dict(pay=14.5, minutes=65, miles=22.0)),
    ("$8.00 5 min (1.0 mi) away 30 min (9.0 mi) total", dict(minutes=30, miles=9.0, legs=1)),
    ("$8.00 30 min (52 mi) total", dict(miles=5.2, miles_corrected=True, miles_uncertain=False)),
    ("$8.00 10 min (20.5 mi)", dict(miles=20.5, miles_corrected=False, miles_uncertain=True)),
    ("Shop & Deliver $12.10 14 items 41 min (3.3 mi) total", dict(pay=12.1, items=14, shop=True)),
    ("Deliver by 12:05 AM Pickup Green Noodle Customer dropoff $6.40 2.2 mi", dict(pay=6.4, minutes=None, miles=2.2, deliver_by=5, complete=True, legs=0)),
    ("delivered by 1.45pm $6.40", dict(deliver_by=825, miles=None)),
    ("Deliver by 13:45 PM", dict(deliver_by=None, complete=False)),
    ("4 mi from charger 12 min", dict(miles=None, minutes=12, pay=None, complete=False)),
    ("E 12 St & S 4S Main Ave", dict(pay=None)),
    ("$2500.00 53L min (1.2 mi)", dict(pay=None, minutes=None, legs=0)),
    ("$5.00 lOO min", dict(minutes=None)),  # no real digit
    ("$5.00 10 mintotal", dict(minutes=None)),
    ("$5.00 7 min (2.0 mi)  totalé", dict(minutes=7, miles=2.0)),
    ("", dict(pay=None, minutes=None, miles=None, legs=0, places=[], complete=False)),
    (None, dict(pay=None, legs=0)),
    ("x" * 50_000 + " $4.00 9 min", dict(pay=4.0, minutes=9)),
]


def test_readings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CARDS)], "i int, text string")
    for row, (card, want) in zip(text.parse(df).orderBy("i").collect(), CARDS):
        for name, value in want.items():
            assert row[name] == pytest.approx(value) if isinstance(value, float) else row[name] == value, (card, name, row[name])


def test_places(spark):
    cards = [
        ("$8.10 6 min (1.2 mi) Oak St & Elm St, Dover 14 min (5.5 mi) Harbour Rd, Dover Accept", ["Oak St & Elm St, Dover", "Harbour Rd, Dover"]),
        ("Deliver by 6:10 PM Blue Kettle 3 items 1.1 mi $7.00 Accept", ["Blue Kettle"]),
        ("$41.00 Pickup Rice Garden No 4 (2 orders) Customer dropoff", ["Rice Garden No 4"]),
        ("$8.10 6 min (1.2 mi) away 14 min (5.5 mi) trip", []),
        ("$8 6 min (1 mi) Oak St, Dover 7 min (1 mi) OAK ST, dover", ["Oak St, Dover"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cards)], "i int, text string")
    assert [r.places for r in text.parse(df).orderBy("i").collect()] == [p for _, p in cards]


def test_numbers(spark):
    tokens = {"12": 12, "1,5": 1.5, "lO.S": 10.5, "+3": 3, ".5": 0.5, "1.": 1, "1e3": None, "Infinity": None, "12d": None, "1,2,3": None, "": None, " 7 ": 7, None: None}
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", text.to_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == tokens


def test_wholeness(spark):
    cards = [("$5 9 min (1.0 mi) total", True), ("$5 3 min (1.0 mi) away 9 min (2.0 mi) trip", True), ("$5 9 min (1.0 mi) trip", False), ("$5 2.0 mi Deliver by 6:10 PM", True), ("$5 Deliver by 6:10 PM", False), ("9 min total", False)]
    df = text.parse(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cards)], "i int, text string"))
    whole = rating.is_whole(F.col("complete"), F.lit(None), F.col("leg_detail"), F.col("legs"), F.col("deliver_by"), F.col("miles"))
    assert [r[0] for r in df.orderBy("i").select(whole).collect()] == [w for _, w in cards]
