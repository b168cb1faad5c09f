"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``POINTS`` places of a ring of 2^32 positions; a row belongs to the
next place clockwise of its doc_id's position.  A shard takes only as many rows as its
bound; rows that meet a full shard continue clockwise to the next place whose shard has
room.  With ``slack`` 0 the bounds are the equal shares themselves (counts at most one
apart); with more slack fewer rows move on.

Only counts travel to the driver: one for each arc of the ring, a number fixed by the
parameters.  There the arcs are filled clockwise, which gives each arc's rows, in order of
position, a list of ranges with a shard and a first slot.  Inside an arc rows are numbered
in ``CELLS`` parts, so that no task sorts a whole arc.

Null texts have no bytes (size 8, crc32 of nothing: 0).  Null doc_ids take the position of
an empty key.  Repeated rows each get a slot of their own.  Of a very long text only its length
and checksum go anywhere; an empty table gives an empty result, and columns beside ``doc_id``
and ``text``, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.common import materialise

POINTS, CELLS = 64, 16
RING = 1 << 32


def position(key: Column) -> Column:
    """Place on the ring: the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise."""
    from hashlib import md5

    return sorted((int(md5(f"shard {s} point {p}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for p in range(points))


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard: its equal share, times 1 + slack, rounded up."""
    even = [total // shards + (s < total % shards) for s in range(shards)]
    return even if not slack else [-int(-(1 + slack) * total // shards)] * shards


def fill(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rows, shard, first slot): where each arc's rows go.

    First every arc's rows go to its own shard, clockwise, while there is room; then what is
    left of each arc continues clockwise.
    """
    room, slots = room[:], [0] * len(room)
    out, rest = [], []

    def put(arc: int, rank: int, rows: int, shard: int) -> int:
        n = min(rows, room[shard])
        if n:
            out.append((arc, rank, n, shard, slots[shard]))
            room[shard] -= n
            slots[shard] += n
        return n

    for arc, (_, shard) in enumerate(nodes):
        rows = counts.get(arc, 0)
        n = put(arc, 0, rows, shard)
        if n < rows:
            rest.append((arc, n, rows - n))
    for arc, rank, rows in rest:
        for k in range(1, len(nodes) + 1):
            if not rows:
                break
            n = put(arc, rank, rows, nodes[(arc + k) % len(nodes)][1])
            rank, rows = rank + n, rows - n
    return out


def arc_of(place: Column, nodes: list[tuple[int, int]]) -> Column:
    """Index of the first node at or after ``place`` (after the last: 0), by bisection over a literal array."""
    at = F.array(*(F.lit(p) for p, _ in nodes))
    steps = max(1, len(nodes).bit_length())
    low = F.lit(0)
    # nodes strictly before the place, built from the highest bit down
    found = F.aggregate(
        F.array(*(F.lit(1 << i) for i in reversed(range(steps)))),
        low,
        lambda acc, step: F.when((acc + step <= len(nodes)) & (F.get(at, F.least(acc + step, F.lit(len(nodes))) - 1) < place), acc + step).otherwise(acc),
    )
    return found % len(nodes)


def assign(docs: DataFrame, shards: int = 24, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    nodes = ring(shards)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), position(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"))
    rows = rows.withColumn("arc", arc_of(F.col("place"), nodes))
    # parts of an arc by position: neighbours on the ring stay neighbours
    starts, lengths = zip(*((nodes[i - 1][0], (nodes[i][0] - nodes[i - 1][0]) % RING or RING) for i in range(len(nodes))))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("arc"))
    into = F.pmod(F.col("place") - pick(starts) - 1, F.lit(RING))
    rows = materialise(rows.withColumn("cell", F.floor(into * CELLS / pick(lengths)).cast("int")).withColumn("into", into))
    counts = rows.groupBy("arc", "cell").count().collect()  # at most shards * POINTS * CELLS numbers
    arcs: dict[int, int] = {}
    cells = []
    for r in sorted(counts, key=lambda r: (r["arc"], r["cell"])):
        cells.append((r["arc"], r["cell"], arcs.get(r["arc"], 0)))
        arcs[r["arc"]] = arcs.get(r["arc"], 0) + r["count"]
    places = fill(arcs, nodes, bounds(sum(arcs.values()), shards, slack))
    ranges: dict[int, list] = {}
    for arc, rank, n, shard, slot in places:
        ranges.setdefault(arc, []).append((rank, n, shard, slot))
    plan = [(a, c, before, ranges[a]) for a, c, before in cells]
    plan = spark.createDataFrame(plan, "arc int, cell int, before long, ranges array<struct<rank:long,n:long,shard:int,slot:long>>")
    order = W.partitionBy("arc", "cell").orderBy("into", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(plan), ["arc", "cell"])  # bounded as the counts are
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth"))
    own = F.filter("ranges", lambda r: (r["rank"] <= F.col("rank")) & (F.col("rank") < r["rank"] + r["n"]))[0]
    return ranked.withColumn("own", own).select("doc_id", "size", "text_crc32", F.col("own.shard").alias("shard"), (F.col("own.slot") + F.col("rank") - F.col("own.rank")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
