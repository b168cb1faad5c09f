"""Replication of a journal to a copy: what is missing, from where on, in which chunks.

A watermark with overlap says where to begin; keys say what the far side already has, so a
second run adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Overlap and first reach in milliseconds, rows in a chunk.
OVERLAP_MS, FIRST_MS, CHUNK = 3_600_000, 30 * 86_400_000, 2000


def fresh(batch: DataFrame, have: DataFrame, key: str = "sync_key") -> DataFrame:
    """Rows of ``batch`` whose key the copy lacks, the first of each key; rows without a key are left out."""
    first = W.partitionBy(key).orderBy("ord")
    new = batch.where(F.col(key).isNotNull()).join(have.select(key).distinct(), key, "left_anti")
    return new.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def distinct_rows(batch: DataFrame, key: str = "sync_key") -> DataFrame:
    first = W.partitionBy(key).orderBy("ord")
    return batch.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def ingest_counts(batch: DataFrame, have: DataFrame, key: str = "sync_key") -> DataFrame:
    """One row: rows added, duplicates and malformed ones."""
    added = fresh(batch, have, key).agg(F.count("*").alias("added"))
    every = batch.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("malformed"))
    return added.crossJoin(every).select("added", (F.col("rows") - F.col("malformed") - F.col("added")).alias("duplicates"), "malformed")


def floor_of(mine: DataFrame, far: DataFrame, by: list[str], now_ms: Column) -> DataFrame:
    """From when on to send: ``by, newest_ms, floor_ms``.

    Overlap before the far side's newest row; everything if it has fewer rows up to there;
    a month without any.
    """
    theirs = far.groupBy(*by).agg(F.max("seen_ms").alias("newest_ms"), F.count("*").alias("theirs"))
    upto = mine.join(theirs, by, "left").groupBy(*by).agg(F.max("newest_ms").alias("newest_ms"), F.max("theirs").alias("theirs"), F.count_if(F.col("seen_ms") <= F.col("newest_ms")).alias("ours"))
    floor = F.when(F.col("newest_ms").isNull(), now_ms - FIRST_MS).when(F.col("ours") > F.col("theirs"), 0).otherwise(F.col("newest_ms") - OVERLAP_MS)
    return upto.select(*by, "newest_ms", floor.alias("floor_ms"))


def plan(mine: DataFrame, far: DataFrame, by: list[str], now_ms: Column) -> DataFrame:
    """Rows to send with their chunk, for each of ``by``."""
    floors = floor_of(mine, far, by, now_ms)
    rows = mine.join(floors, by).where(F.coalesce("seen_ms", F.lit(0)) >= F.col("floor_ms"))
    nth = F.row_number().over(W.partitionBy(*by).orderBy("ord"))
    return rows.withColumn("chunk", F.floor((nth - 1) / CHUNK).cast("long"))
