"""The training-data pipeline over ``documents``.

Low-quality documents go, one document of each near-duplicate class stays, secrets are
masked, sources are mixed to their target weights, and what remains is encoded.  Each stage
takes (spark, docs, sf_dir); its result is written as Parquet and read again for the next.
All read and hand on texts in small batches, so that a task's memory doesn't grow with its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm import bpe, mixing, neardup, quality, secrets
from offerloom.llm.common import materialise, small_batches, table
from offerloom.llm.queries import vocabulary

#: Score from which a document is kept.
LEAST_QUALITY = 0.3
#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of ``LEAST_QUALITY`` or more.  Null and empty texts have the model's bias as their score; very
    long texts are scored whole; repeated rows, ties and columns of any name stay as they are; an empty table stays empty."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(F.col("text"), model) >= LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates.  Rows that share a doc_id are one document, of which the first by
    text stays.  Null and empty texts, and those without words, are like no other and stay, as does a null doc_id; very
    long texts are compared whole; columns of any name stay; an empty table stays empty."""
    small_batches(spark)
    classes = neardup.near_classes(docs, size=SHINGLE)
    gone = materialise(classes.where("NOT kept").select("doc_id").distinct())
    again = materialise(classes.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    small = lambda ids: F.broadcast(ids) if ids.count() <= neardup.BROADCAST_ROWS else ids
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    rows = kept.join(again, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("doc"))
    order = W.partitionBy("doc_id").orderBy("doc.text", F.to_json("doc"))
    first = rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("doc.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each run of overlapping secrets replaced by its first one's kind in brackets, ``n_chars`` counted anew.
    Null and empty texts stay as they are, and every row stays, repeated ones too; very long texts are read whole; columns of
    any name stay; an empty table stays empty."""
    small_batches(spark)
    masked = docs.withColumn("text", secrets.redact(F.col("text")))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order.  Texts without words (null, empty) take nothing of the budget
    and stay if their place is before its end; a null source is a source of its own.  Rows that share doc_id, source and
    size are taken equally often, as often as the one of them that is taken most."""
    small_batches(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number for every row, repeated ones too; null and empty texts have none.  Very long texts are
    encoded whole; columns beside these and doc_id, lang and source end here; an empty table stays empty."""
    small_batches(spark)
    return bpe.encode_documents(docs, *vocabulary()).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("quality classifier", good_quality),
    ("near dedup", near_dedup),
    ("secret scans", mask_secrets),
    ("source mixing", mix_sources),
    ("bpe encoding", encode),
]

#: A trained classifier and hashed sketches have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
