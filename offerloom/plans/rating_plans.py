"""Queries of the rating and text families."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import rating, text
from offerloom.plans.base import query
from offerloom.sources import fixtures as fx

COST, TARGET, BAND = 0.3, 25.0, 15.0


def rated(spark, sf_dir, variant="uniform"):
    o = fx.offers(spark, sf_dir, variant)
    r = rating.rate(F.col("pay"), F.col("minutes"), F.col("miles"), cost_per_mile=F.lit(COST), target=F.lit(TARGET), band=F.lit(BAND))
    return o.withColumns({k: v for k, v in r.items() if k not in o.columns})


DOUBT = "CASE WHEN pay IS NULL THEN NULL WHEN NOT pay BETWEEN 1 AND 300 THEN 'pay' WHEN minutes IS NULL THEN NULL WHEN NOT minutes BETWEEN 2 AND 240 THEN 'time' WHEN miles >= 1 AND miles / (minutes / 60) > 75 THEN 'speed' END"
RATED = f"""(SELECT *, CASE WHEN doubt IS NOT NULL THEN 'doubt' WHEN per_hour >= {TARGET}::DOUBLE THEN 'go' WHEN per_hour >= {TARGET}::DOUBLE * (1 - {BAND}::DOUBLE / 100) THEN 'warn' ELSE 'no' END AS state
  FROM (SELECT *, net / (minutes / 60) AS per_hour, pay / (minutes / 60) AS gross_per_hour, CASE WHEN miles <> 0 THEN net / miles END AS per_mile, {DOUBT} AS doubt
    FROM (SELECT *, pay - cost AS net FROM (SELECT *, coalesce(miles, 0) * {COST}::DOUBLE AS cost FROM {fx.offers_sql()}))))"""


@query(f"SELECT ord, cost, net, per_hour, gross_per_hour, per_mile, doubt, state FROM {RATED}")
def rate_verdict(spark, sf_dir):
    return rated(spark, sf_dir).select("ord", "cost", "net", "per_hour", "gross_per_hour", "per_mile", "doubt", "state")


@query(f"SELECT rig, state, count(*) AS offers FROM {RATED} GROUP BY rig, state")
def rate_state_counts(spark, sf_dir):
    return rated(spark, sf_dir).groupBy("rig", "state").agg(F.count("*").alias("offers"))


_DAMAGED = "SELECT ord, CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 11 = 0 THEN pay * 100 ELSE pay END AS pay, CASE WHEN ord % 13 = 0 THEN NULL WHEN ord % 17 = 0 THEN minutes * 60 ELSE minutes END AS minutes, CASE WHEN ord % 5 = 0 THEN NULL WHEN ord % 3 = 0 THEN miles * 10 ELSE miles END AS miles FROM {o}"


@query(f"SELECT ord, {DOUBT} AS doubt, pay IS NULL OR minutes IS NULL OR ({DOUBT}) IS NOT NULL AS suspect FROM ({_DAMAGED.replace('{o}', fx.offers_sql())})")
def doubt_reason(spark, sf_dir):
    d = spark.sql(_DAMAGED, o=fx.offers(spark, sf_dir))
    values = [F.col(c) for c in ("pay", "minutes", "miles")]
    return d.select("ord", rating.doubt(*values).alias("doubt"), rating.suspect(*values).alias("suspect"))


@query(f"""SELECT target, cost_per_mile, state, count(*) AS offers FROM (
  SELECT target, cost_per_mile, CASE WHEN ({DOUBT}) IS NOT NULL THEN 'doubt' WHEN ph >= target THEN 'go' WHEN ph >= target * (1 - 15.0::DOUBLE / 100) THEN 'warn' ELSE 'no' END AS state
  FROM (SELECT *, (pay - miles * cost_per_mile) / (minutes / 60) AS ph FROM {fx.offers_sql()},
    (SELECT unnest([15.0, 20.0, 25.0, 30.0])::DOUBLE AS target) t, (SELECT unnest([0.0, 0.3, 0.67])::DOUBLE AS cost_per_mile) c)) GROUP BY ALL""")
def rate_settings_sweep(spark, sf_dir):
    """Every offer under each of a few settings, which are a small table of fixed size."""
    settings = [F.struct(F.lit(t).alias("target"), F.lit(c).alias("cost_per_mile")) for t in (15.0, 20.0, 25.0, 30.0) for c in (0.0, 0.3, 0.67)]
    o = fx.offers(spark, sf_dir).withColumn("s", F.explode(F.array(*settings)))
    r = rating.rate(F.col("pay"), F.col("minutes"), F.col("miles"), target=F.col("s.target"), cost_per_mile=F.col("s.cost_per_mile"))
    return o.select(F.col("s.target").alias("target"), F.col("s.cost_per_mile").alias("cost_per_mile"), r["state"].alias("state")).groupBy("target", "cost_per_mile", "state").agg(F.count("*").alias("offers"))


_LOST = "SELECT ord, minutes, miles * CASE WHEN ord % 3 = 0 THEN 10 WHEN ord % 3 = 1 THEN 4 ELSE 1 END AS miles, ord % 4 = 0 AS dec FROM {o}"
_LOST_SQL = f"({_LOST.replace('{o}', fx.offers_sql())})"


@query(f"""SELECT ord, CASE WHEN lost THEN miles / 10 ELSE miles END AS miles, lost AS corrected
  FROM (SELECT *, NOT dec AND miles / (minutes / 60) > 55 AND miles / 10 / (minutes / 60) BETWEEN 0.5 AND 55 AS lost FROM {_LOST_SQL})""")
def decimal_recovery(spark, sf_dir):
    d = spark.sql(_LOST, o=fx.offers(spark, sf_dir))
    return d.select("ord", rating.recover_decimal(F.col("minutes"), F.col("miles"), F.col("dec")).alias("r")).select("ord", "r.*")


@query(f"""SELECT ord, CASE WHEN lost THEN miles / 10 ELSE miles END AS miles, lost AS corrected, NOT lost AND mph > 75 AS uncertain
  FROM (SELECT *, NOT dec AND mph > 55 AND mph / 10 BETWEEN 0.5 AND 55 AS lost FROM (SELECT *, miles / (minutes / 60) AS mph FROM {_LOST_SQL}))""")
def distance_check(spark, sf_dir):
    d = spark.sql(_LOST, o=fx.offers(spark, sf_dir))
    return d.select("ord", rating.check_distance(F.col("minutes"), F.col("miles"), F.col("dec")).alias("r")).select("ord", "r.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS cents FROM lineitem")
def round2(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", rating.round2(F.col("l_extendedprice") * F.col("l_discount")).alias("cents"))


CARDS = fx.card_numbers_sql()


def cards(spark, sf_dir):
    """Card texts, dealt before they are read: reading a card costs more than moving its numbers."""
    return fx.cards(spark, sf_dir, dealt=True)


@query(f"SELECT ord, CASE WHEN kind = 2 THEN hr % 12 * 60 + mi + 720 END AS deadline FROM {CARDS}")
def deadline_minutes(spark, sf_dir):
    return fx.cards(spark, sf_dir).select("ord", text.find_deadline(F.col("text")).cast("long").alias("deadline"))


@query(f"SELECT ord, CASE WHEN d < n THEN d - n + 1440 ELSE d - n END::DOUBLE AS wait FROM (SELECT ord, hr % 12 * 60 + mi + 720 AS d, ord % 1440 AS n FROM {CARDS} WHERE kind = 2)")
def minutes_until(spark, sf_dir):
    c = fx.cards(spark, sf_dir).where("kind = 2")
    return c.select("ord", rating.minutes_until(text.find_deadline(F.col("text")), F.col("ord") % 1440).alias("wait"))


@query(f"SELECT ord, cents::VARCHAR AS digits FROM {CARDS}")
def card_fix_digits(spark, sf_dir):
    """Digits written as lookalikes come back as digits."""
    c = fx.card_numbers(spark, sf_dir)
    return c.select("ord", text.fix_digits(F.translate(F.col("cents").cast("string"), "01256789", "OlZSGTBg")).alias("digits"))


@query(f"SELECT ord, CASE WHEN ord % 3 = 0 THEN NULL ELSE d2 + 0.5::DOUBLE END AS number FROM {CARDS}")
def card_to_number(spark, sf_dir):
    c = fx.card_numbers(spark, sf_dir)
    token = F.concat(F.col("d2"), F.when(F.col("ord") % 3 == 1, ",5").when(F.col("ord") % 3 == 2, ".S").otherwise(".5x"))
    return c.select("ord", text.to_number(token).alias("number"))


@query(f"SELECT ord, cents / 100.0::DOUBLE AS pay FROM {CARDS}")
def card_pay(spark, sf_dir):
    return fx.cards(spark, sf_dir).select("ord", text.find_pay(F.col("text")).alias("pay"))


@query(f"SELECT ord, CASE WHEN kind = 1 THEN items::DOUBLE END AS items FROM {CARDS}")
def card_items(spark, sf_dir):
    return fx.cards(spark, sf_dir).select("ord", text.find_items(F.col("text")).alias("items"))


@query(f"""SELECT ord, 0 AS nth, (CASE WHEN kind = 1 THEN m2 ELSE m1 END)::DOUBLE AS minutes, (CASE WHEN kind = 1 THEN d2 ELSE d1 END) + 0.5::DOUBLE AS miles, kind <> 0 AS is_total FROM {CARDS} WHERE kind <> 2
  UNION ALL SELECT ord, 1, m2::DOUBLE, d2 + 0.5::DOUBLE, false FROM {CARDS} WHERE kind = 0""")
def card_legs(spark, sf_dir):
    c = cards(spark, sf_dir).select("ord", F.posexplode(text.find_legs(F.col("text"))).alias("nth", "leg"))
    return c.select("ord", "nth", "leg.minutes", "leg.miles", "leg.is_total")


@query(f"""SELECT ord, cents / 100.0::DOUBLE AS pay, (CASE kind WHEN 0 THEN m1 + m2 WHEN 1 THEN m2 WHEN 3 THEN m1 END)::DOUBLE AS minutes,
  m AS miles, (CASE kind WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE 1 END) AS legs, m / (t / 60.0::DOUBLE) > 75 AND kind <> 2 AS miles_uncertain,
  CASE WHEN kind = 3 THEN true END AS shop, true AS complete, true AS whole
  FROM (SELECT *, (CASE kind WHEN 0 THEN d1 + d2 + 1.0::DOUBLE WHEN 3 THEN d1 + 0.5::DOUBLE ELSE d2 + 0.5::DOUBLE END) AS m, CASE kind WHEN 0 THEN m1 + m2 WHEN 1 THEN m2 ELSE m1 END AS t FROM {CARDS})""")
def card_parse(spark, sf_dir):
    p = text.parse(cards(spark, sf_dir).select("ord", "text"))
    whole = rating.is_whole(F.col("complete"), F.lit(False), F.col("leg_detail"), F.col("legs"), F.col("deliver_by"), F.col("miles"))
    return p.select("ord", "pay", "minutes", "miles", "legs", "miles_uncertain", "shop", "complete", whole.alias("whole"))


@query(f"SELECT ord, CASE WHEN kind = 2 THEN 'Corner Bakery' ELSE '' END AS places FROM {CARDS}")
def card_places(spark, sf_dir):
    return cards(spark, sf_dir).select("ord", F.array_join(text.find_places(F.col("text")), "|").alias("places"))
