"""Shared helpers: reading tables, cutting lineage into the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: the space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset
    (tests, a single machine) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="offerloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends there, so a lost executor costs a reread and not a recomputation, and
    every later use sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that the Parquet reader holds at once, and bytes of an Arrow batch on its way to or from Python.  Spark's own 4096
#: rows and 64 MB are whole partitions of texts, held several times over by a task and its Python worker.
SMALL_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def small_batches(spark: SparkSession) -> None:
    """Texts are read and handed to Python a little at a time, whatever the size of a partition.

    This holds for the session, as what is built next runs when the caller asks for it; what
    the caller has set stays.
    """
    for key, most in SMALL_BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def text_slices(texts: pa.Array, size: int = 1 << 18) -> Iterator[list[str]]:
    """An Arrow batch of texts as short lists of Python strings, each of about ``size`` bytes
    (or one longer text), so that a batch is never held a second time; nulls are empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the splitmix64 finish)."""
    x = x + _M[0]
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))
