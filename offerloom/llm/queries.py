"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import bpe, embedding_dedup, fim, fingerprints, hnsw, lm_score, merkle, mixing, neardup, quality, secrets, sharding, url_filter
from offerloom.llm.common import table, text_or_empty


def vocabulary() -> tuple[str, str]:
    """Path of the ranks file and the pattern of its pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(text_or_empty(), *vocabulary())
    return table(spark, sf_dir, "documents").select("doc_id", done.alias("d")).select("doc_id", F.col("d.*"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest_report(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_secrets, op3_embedding_dedup, op4_quality, op5_sharding, op6_bpe, op7_url_filter, op8_lm_score, op9_mixing, op10_neardup, op11_nearest, op12_fill_in_middle, op13_merkle_manifest)
}
ORACLES: dict[str, str] = {
    "op3_embedding_dedup": embedding_dedup.EMBEDDING_SQL,
    "op7_url_filter": url_filter.URL_SQL,
    "op9_mixing": mixing.MIX_SQL,
    "op10_neardup": neardup.NEARDUP_SQL,
    "op11_nearest": hnsw.NEAREST_SQL,
    "op12_fill_in_middle": fim.FIM_SQL,
    "op13_merkle_manifest": merkle.MERKLE_SQL,
}
