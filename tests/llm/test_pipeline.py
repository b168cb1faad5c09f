import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from offerloom.llm import quality, secrets
from offerloom.llm.common import SMALL_BATCHES, materialise, table
from offerloom.llm.queries import ORACLES, QUERIES

from .helpers import docs
from .test_bpe import PATH, PATTERN
from .test_neardup import brute, sets

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    held = table(spark, SF, "documents")
    columns = held.columns
    stages = dict(corpus_pipeline.STAGES)
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = held.collect()
        held = materialise(stage(spark, held, SF))
        rows[name] = (before, held.collect())
        assert name == "bpe encoding" or held.columns == columns
    before, after = rows["quality classifier"]
    junk = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
    clean = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    kept = {r.doc_id for r in after}
    taught = {i for i in junk if zlib.crc32(str(i).encode()) % 5}
    assert not taught & kept and clean & {r.doc_id for r in before} <= kept
    before, after = rows["near dedup"]
    want = brute([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in want.items() if i == c)
    before, after = rows["secret scans"]
    scan = secrets.scanner(secrets.RULES)
    assert len(before) == len(after) and not any(i < 2 for r in after for _, i, _ in scan.spans(r.text)) and all(r.n_chars == len(r.text) for r in after)
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after if not scan.spans(texts[r.doc_id]))
    before, after = rows["source mixing"]
    size = lambda some: sum(len(r.text.split()) for r in some)
    assert 1.45 * size(before) < size(after) <= 1.5 * size(before) and max(Counter(r.doc_id for r in after).values()) <= 2
    before, after = rows["bpe encoding"]
    from offerloom.llm import bpe

    codec = bpe.codec(PATH, PATTERN)
    assert Counter((r.doc_id, codec.decode(r.token_ids).decode()) for r in after) == Counter((r.doc_id, r.text) for r in before)
    assert set(stages) == set(rows)


def test_quality_stage_parts_junk_from_clean(spark):
    """Held-out rows too, on a table with enough labels to learn from."""
    sf = "/root/testdata/sf0.01"
    held, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, held, sf).select("doc_id").collect()}
    junk, clean = ({r.doc_id for r in labels.where(f"quality = {q}").collect()} for q in (0, 1))
    assert not junk & kept and clean <= kept


def test_stages_on_awkward_rows(spark):
    held = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, held, SF))
        assert name == "bpe encoding" or out.columns == held.columns
        if name == "near dedup":
            assert max(Counter(r.doc_id for r in out.select("doc_id").collect()).values()) == 1
        held = out
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF).count() == 0


def test_stages_hand_texts_on_in_small_batches(spark):
    """Spark's own batches hold a partition's texts whole: 10,000 rows, up to 64 MB."""

    @F.arrow_udf("long")
    def batch_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([texts.nbytes] * len(texts), pa.int64())

    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = materialise(spark.range(4000).select(F.repeat(F.lit("word "), 1000).alias("text")).coalesce(1))  # 20 MB
    try:
        for _, stage in corpus_pipeline.STAGES:
            for key in SMALL_BATCHES:
                spark.conf.unset(key)
            stage(spark, docs(spark, []), SF)
            assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
            assert texts.select(batch_bytes("text").alias("n")).agg(F.max("n")).first()[0] <= 4 << 20
        spark.conf.set(most, "1m")
        corpus_pipeline.mask_secrets(spark, docs(spark, []), SF)
        assert spark.conf.get(most) == "1m"  # what the caller has set stays
    finally:
        for key in SMALL_BATCHES:
            spark.conf.unset(key)


def test_registered(spark):
    assert sorted(QUERIES) == sorted(f"op{n}_{x}" for n, x in enumerate(("fingerprints", "secrets", "embedding_dedup", "quality", "sharding", "bpe", "url_filter", "lm_score", "mixing", "neardup", "nearest", "fill_in_middle", "merkle_manifest"), 1))
    assert set(ORACLES) <= set(QUERIES) and quality.BUCKETS and sets("a b", 4)
