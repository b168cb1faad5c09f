"""Queries of the streams into the journal: framing and routing, bodies, first-wins copies, last values, stored settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.plans import frame_plans, sync_plans
from offerloom.plans.base import ORACLES, query
from offerloom.plans.control_plans import events
from offerloom.plans.stream_plans import _folder, feed, finish, named_states
from offerloom.streaming import ingest
from offerloom.streaming.machines import dealt, fold, live

#: What a producer prints: log lines, phases, readings, blanks, now and then two lines at once; each in two pieces.
_PRINTED = (
    "SELECT user_id % 4 AS rig, event_id AS e, CASE event_id % 4 WHEN 0 THEN 'scanner up ' || event_id WHEN 1 THEN '{\"phase\":\"aim\",\"n\":' || event_id || '}' WHEN 2 THEN '{\"ready\":true,\"pay\":' || event_id % 30 || '}'"
    " ELSE '   ' END AS said, event_id % 5 = 0 AS twice FROM {events}"
)
PRINTED = _PRINTED.replace("{events}", "events")


def pieces(spark, sf_dir) -> DataFrame:
    p = events(spark, sf_dir, _PRINTED)
    text = F.concat("said", F.lit("\n"), F.when(F.col("twice"), F.concat(F.lit("  "), F.col("said"), F.lit("\n"))).otherwise(F.lit("")))
    cut = (F.col("e") * 7) % 20
    two = F.explode(F.array(F.struct((F.col("e") * 2).alias("ord"), F.substring("text", F.lit(1), cut.cast("int")).alias("chunk")), F.struct((F.col("e") * 2 + 1).alias("ord"), F.substring("text", (cut + 1).cast("int"), F.length("text")).alias("chunk"))))
    return p.withColumn("text", text).select("rig", two.alias("p")).select("rig", "p.ord", (1000 + F.col("p.ord") * 10).alias("ts_ms"), F.nullif("p.chunk", F.lit("")).alias("chunk"))


_LINES = f"""SELECT rig, row_number() OVER (PARTITION BY rig ORDER BY e, nth) - 1 AS ord, said AS line, CASE WHEN e % 4 = 0 THEN 'log' ELSE 'journal' END AS route
  FROM (SELECT *, unnest(CASE WHEN twice THEN [0, 1] ELSE [0] END) AS nth FROM ({PRINTED})) WHERE trim(said) <> ''"""


@query(_LINES)
def framed_lines(spark, sf_dir):
    return ingest.routed(fold(pieces(spark, sf_dir), ingest.Framing)).select("rig", "ord", "line", "route")


@query(_LINES)
def stream_routes(spark, sf_dir):
    """The pieces as a stream, framed, and routed to two sinks."""
    at = _folder(spark)
    rows = pieces(spark, sf_dir)
    fed = feed(spark, rows, at, 3, "ts_ms")
    with named_states(spark, rows):
        finish(ingest.route(live(fed, ingest.Framing), f"{at}/journal", f"{at}/log"), at, "routes")
    read = lambda name: ingest.stored(spark, f"{at}/{name}", ingest.LINE).select("rig", "ord", "line", F.lit(name).alias("route"))
    return read("journal").unionByName(read("log"))


def batch_bytes(sent: int | None) -> int:
    """What a micro-batch reads: a fourth of all that was sent, so that batches grow before their number does."""
    return min(max((sent or 0) // 4, 128 << 10), 64 << 20)


_SENT = "SELECT event_id // 100 AS body, event_id AS ord, CASE WHEN event_id % 6 = 0 THEN '' ELSE '{{\"id\":' || event_id || ',\"note\":\"' || {pad} || '\"}}' END AS line FROM {events}"
_PAD = "repeat('x', (event_id // 100 * 13) % 90)"
CAP = 6000


@query(f"""SELECT body, bytes, CASE WHEN bytes > {CAP} THEN 'body over {CAP} bytes' END AS reason, CASE WHEN bytes > {CAP} THEN 0 ELSE lines END AS lines
  FROM (SELECT body, sum(strlen(line) + 1)::BIGINT AS bytes, count(*) FILTER (WHERE line <> '') AS lines FROM ({_SENT.format(pad=_PAD, events='events')}) GROUP BY body)""")
def stream_bodies(spark, sf_dir):
    """Bodies sent as files: those over the cap are refused unread, of the others the lines are counted."""
    at = _folder(spark)
    sent = events(spark, sf_dir, _SENT.format(pad=_PAD, events="{events}"))
    dealt(sent, "body").sortWithinPartitions("body", "ord").select("body", F.col("line").alias("value")).write.partitionBy("body").text(f"{at}/in")
    told = ingest.bodies(spark, f"{at}/in/body=*/*.txt", CAP, batch_bytes(sent.agg(F.sum(F.length("line") + 1)).first()[0]), "off")
    finish(told.writeStream.format("parquet").option("path", f"{at}/out").outputMode("append"), at, "bodies")
    told = spark.read.parquet(f"{at}/out")
    lines = ingest.body_lines(told).groupBy("path").count()
    return told.join(lines, "path", "left").select(F.regexp_extract("path", r"body=(\d+)", 1).cast("long").alias("body"), "bytes", "reason", F.coalesce("count", F.lit(0)).cast("long").alias("lines"))


@query(ORACLES["ingest_distinct"])
def stream_ingest_first(spark, sf_dir):
    """Of all copies of a row the first that came, whatever batch it came in."""
    at = _folder(spark)
    rows = sync_plans.batch(spark, sf_dir).select("ord", F.lit(None).cast("string").alias("line"), "sync_key")
    finish(ingest.ingest(feed(spark, rows, at, 4, "ord"), f"{at}/store", f"{at}/counts"), at, "ingest")
    return ingest.stored(spark, f"{at}/store", ingest.KEYED).select("ord", "sync_key")


@query(ORACLES["live_view"])
def stream_last_values(spark, sf_dir):
    at = _folder(spark)
    rows = frame_plans.diffs(spark, sf_dir).select("rig", "ord", "seen_ms", "diff")
    finish(ingest.last_values(feed(spark, rows, at, 3, "seen_ms"), f"{at}/last"), at, "last")
    return ingest.newest_values(spark, f"{at}/last", "rig long, `last` struct<ord:bigint,seen_ms:bigint,diff:bigint>").select("rig", "last.*")


#: Stored settings and what a calibration writes over them; some lack settings, some aren't objects.
_CONFIGS = (
    "SELECT event_id AS ord, CASE WHEN event_id % 9 = 0 THEN '[1]' ELSE '{{\"quad\":[[1,2]],\"trackedQuad\":[[' || event_id || ',0]],\"exposure\":' || event_id % 50 || CASE WHEN event_id % 3 = 0 THEN ',\"settings\":{{\"target\":' || event_id % 40 || '}}' ELSE '' END || '}}' END AS stored,"
    " '{{\"quad\":[[' || event_id % 7 || ',0.5]],\"cropBox\":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '{{\"x\":1}}' END || ',\"cardHeight\":' || event_id % 900 || '}}' AS written FROM {events}"
)


@query("""SELECT event_id AS ord, '{"cardHeight":' || event_id % 900 || ',"cropBox":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '{"x":1}' END || CASE WHEN event_id % 9 = 0 THEN '' ELSE ',"exposure":' || event_id % 50 END
  || ',"quad":[[' || event_id % 7 || ',0.5]],"settings":{"target":' || CASE WHEN event_id % 9 > 0 AND event_id % 3 = 0 THEN event_id % 40 ELSE 25 END || '}}' AS config FROM events""")
def config_merge(spark, sf_dir):
    c = events(spark, sf_dir, _CONFIGS.format(events="{events}"))
    return c.select("ord", ingest.merged_object(F.col("stored"), F.col("written"), ("trackedQuad",), F.lit('{"settings":{"target":25}}')).alias("config"))


_REQUESTS = "SELECT user_id % 4 AS rig, event_id AS ord, CASE event_id % 6 WHEN 0 THEN '{{\"quad\":null}}' WHEN 1 THEN '[1]' WHEN 2 THEN '{{\"quad\"' ELSE {spelled} END AS body FROM {events}"


@query("""WITH r AS (SELECT user_id % 4 AS rig, event_id AS ord, CASE WHEN event_id % 6 > 2 THEN (event_id // 24) % 5 END AS said FROM events)
SELECT rig, ord, said IS NOT NULL AND said IS DISTINCT FROM coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY rig ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN rig = 1 THEN 0 END) AS changed,
  CASE WHEN said IS NULL THEN 'not a calibration' END AS error FROM r""")
def config_backup(spark, sf_dir):
    """Spellings of one calibration don't change it; rig 1 has the first one already."""
    spelled = "CASE WHEN event_id % 2 = 0 THEN '{{\"quad\":[[' || (event_id // 24) % 5 || ',1]],\"a\":1}}' ELSE '{{ \"a\":1, \"quad\": [[' || (event_id // 24) % 5 || ', 1]] }}' END".replace("{{", "{").replace("}}", "}")
    r = events(spark, sf_dir, _REQUESTS.format(spelled=spelled, events="{events}"))
    kept = spark.range(1).select(F.lit(1).cast("long").alias("rig"), F.sha2(F.to_json(F.parse_json(F.lit('{"quad":[[0,1]],"a":1}'))).cast("binary"), 256).alias("digest"))
    return ingest.backups(r, kept).select("rig", "ord", "changed", "error")
