import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from offerloom.llm import bpe
from offerloom.llm.queries import vocabulary

from .helpers import awkward, docs

PATH, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
ALPHABET = [chr(c) for c in range(0x180)] + list("\u0085     　﻿日本語٣²Ⅳ́😀𝟘") + [" ", "  ", "\n", "'s", "'ll", " the", "<|endoftext|>"] * 6


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def checked(c, reference, text):
    ids = next(c.encode([text])).tolist()
    again, starts, ends = next(c.spans([text]))
    assert ids == again.tolist() == reference.encode_ordinary(text)
    data = text.encode()
    assert c.decode(next(c.encode([text]))) == data and "".join(c.pieces(text)) == text
    # offsets: code points that a token's bytes touch
    of_byte = [i for i, ch in enumerate(text) for _ in ch.encode()]
    at = 0
    for i, a, b in zip(ids, starts, ends):
        n = len(c.table[i])
        assert (a, b) == (of_byte[at], of_byte[at + n - 1] + 1)
        at += n
    assert at == len(data)


def test_ids_and_offsets_equal_another_library(reference):
    c = bpe.codec(PATH, PATTERN)

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join))
    def check(text):
        checked(c, reference, text)

    check()


def test_cut_texts(reference, monkeypatch):
    """Pieces of a few characters, and calls of a few pieces, change nothing."""
    monkeypatch.setattr(bpe, "PIECE", 5)
    monkeypatch.setattr(bpe, "CALL", 11)
    c = bpe.codec(PATH, PATTERN)

    @settings(max_examples=800, deadline=None)
    @given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
    def check(text):
        checked(c, reference, text)

    check()
    texts = ["some words here", "", "é日本 " * 9, "x" * 40, " other words  there "]
    assert [x.tolist() for x in c.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_very_long_texts(reference):
    c = bpe.codec(PATH, PATTERN)
    for text in ("word é日本 " * 60_000, "x" * 300_000, "日本" * 50_000, "a  b\n" * 60_000, " " * 200_000 + "end"):
        assert next(c.encode([text])).tolist() == reference.encode_ordinary(text)
        assert c.decode(next(c.encode([text]))) == text.encode()


def test_the_byte_table_is_reversed():
    c = bpe.codec(PATH, PATTERN)
    ranks = bpe.read_ranks(PATH)
    assert sorted(map(ord, bpe.byte_chars().values()))[-1] < 512 and len(set(bpe.byte_chars().values())) == 256
    assert all(c.table[r] == t for t, r in ranks.items())


def test_digests_of_every_row(spark, reference):
    done = docs(spark).select("doc_id", F.col("text").alias("t"), bpe.round_trip(F.col("text"), *vocabulary()).alias("r")).collect()
    assert len(done) == len(awkward())
    for row in done:
        text = row.t or ""
        ids = reference.encode_ordinary(text)
        assert row.r.n_tokens == len(ids) and row.r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        _, starts, ends = next(bpe.codec(PATH, PATTERN).spans([text]))
        assert row.r.n_split == sum(s < e for s, e in zip(starts[1:], ends))


def test_columns_and_round_trip(spark):
    rows = bpe.encode_documents(docs(spark), PATH, PATTERN)
    back = rows.select("text", "n_tokens", bpe.decoded(F.col("token_ids"), PATH, PATTERN).alias("b"), bpe.token_spans(F.col("text"), PATH, PATTERN).alias("spans")).collect()
    assert all(bytes(r.b).decode() == (r.text or "") and r.n_tokens == len(r.spans) for r in back)
    assert all(r.spans[-1].end == len(r.text) for r in back if r.text)
    assert bpe.encode_documents(docs(spark, []), PATH, PATTERN).count() == 0
    assert spark.createDataFrame([(None,)], "i array<int>").select(bpe.decoded(F.col("i"), PATH, PATTERN).alias("b")).first().b is None
