"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The tokenizer is built from a ranks file (base64 token, rank).  The library works on
characters, so every byte stands as one printable character (``byte_chars``); decoding
reverses that table for each token's spelling and joins the bytes, which also joins
characters whose bytes lie in several tokens.  Offsets are the library's own: code points,
where tokens that share a character overlap in it.

White space in front of a word belongs to the word's piece, so a text may be cut, without
any change to its ids, in front of a single space between two other characters.  Long texts
are cut so, and the library gets about ``CALL`` characters at once, whatever the number of
rows: memory is bounded by that and by the longest stretch without such a place, and no
state grows from batch to batch.

Null texts encode as empty texts.  Empty texts have no ids.  Very long texts are encoded
whole, piece by piece.  Repeated rows each keep their row, ties don't arise, other columns
pass through untouched whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import text_slices

#: Characters of a piece, and about as many as go to the library in one call.
PIECE, CALL = 1 << 16, 1 << 17
#: A single space between two characters that aren't white space of any kind.
_JOINT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else 256 and up."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``: what merges of lower rank leave of its bytes."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        best, i = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= rank:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """Encoder and byte table for one ranks file and one piece pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_chars()
        spell = lambda token: "".join(map(chars.__getitem__, token))
        pairs = (_halves(t, r, ranks) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1)
        model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in filter(None, pairs)], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the table reversed: each token's characters back to bytes
        back = {ord(c): b for b, c in chars.items()}
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for spelling, i in self.tokenizer.get_vocab().items():
            self.table[i] = spelling.translate(back).encode("latin-1")

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        """``text`` in stretches of about ``PIECE`` characters, cut where tokens never cross."""
        at = 0
        while len(text) - at > PIECE and (joint := _JOINT.search(text, at + PIECE)):
            yield text[at : joint.start()]
            at = joint.start()
        if at < len(text):
            yield text[at:]

    def _encodings(self, texts: list[str], call: Callable) -> Iterator[list]:
        """The library's encodings of each text's pieces; about ``CALL`` characters go to it at once."""
        some, size, cuts = [], 0, []
        for t in texts:
            some += self.pieces(t)
            cuts.append(len(some))
            size += len(t)
            if size > CALL:
                yield from self._cut(call(some, add_special_tokens=False), cuts)
                some, size, cuts = [], 0, []
        yield from self._cut(call(some, add_special_tokens=False), cuts)

    @staticmethod
    def _cut(found: list, cuts: list[int]) -> Iterator[list]:
        for a, b in zip([0, *cuts], cuts):
            yield found[a:b]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each of ``texts``."""
        for found in self._encodings(texts, self.tokenizer.encode_batch_fast):
            yield np.concatenate([np.empty(0, np.int32), *(np.array(e.ids, np.int32) for e in found)])

    def spans(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, and first and one past the last code point of each token; tokens that share a
        character, because its bytes lie in both, overlap in it."""
        for found in self._encodings(texts, self.tokenizer.encode_batch):
            rows, at = [np.empty((3, 0), np.int64)], 0
            for e in found:
                ends = np.array(e.offsets, np.int64).reshape(-1, 2).T
                rows.append(np.vstack([np.array(e.ids, np.int64), ends + at]))
                at = int(rows[-1][2, -1])
            yield tuple(np.concatenate(rows, axis=1))

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, np.asarray(ids, np.int64).tolist()))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """``array<int>``: the ids of each text."""

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            yield _lists([ids for some in text_slices(texts) for ids in c.encode(some)])

    return ids_of(text)


def token_spans(text: Column, path: str, pattern: str) -> Column:
    """``array<struct<id,start,end>>``: ids with their code point offsets."""
    kinds = {"id": pa.int32(), "start": pa.int64(), "end": pa.int64()}

    @F.arrow_udf("array<struct<id:int,start:long,end:long>>")
    def spans_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            rows = [np.stack(x) for some in text_slices(texts) for x in c.spans(some)]
            every = np.concatenate([np.empty((3, 0), np.int64), *rows], axis=1)
            ends = np.cumsum([0, *(r.shape[1] for r in rows)])
            values = pa.StructArray.from_arrays([pa.array(every[k], pa.int64()).cast(kind) for k, kind in enumerate(kinds.values())], names=list(kinds))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return spans_of(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """``binary``: the bytes that ids stand for (null ids: null)."""

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for rows in batches:
            yield pa.array([c.decode(r.values.to_numpy(zero_copy_only=False)) if r.is_valid else None for r in rows], pa.binary())

    return bytes_of(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """``struct<n_tokens,ids_sha256,decoded_sha256,n_split>``: digests of each text's ids and of the
    bytes decoded from them, and how many tokens begin inside a character."""
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_split": pa.int64()}

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
    def digests_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        names = list(map(str, range(len(c.table))))
        inside = np.array([bool(t) and t[0] & 0xC0 == 0x80 for t in c.table])
        for texts in batches:
            rows = []
            for some in text_slices(texts):
                for ids in c.encode(some):
                    said = " ".join(map(names.__getitem__, ids.tolist())).encode()
                    rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest(), int(inside[ids].sum())))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    return digests_of(text)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens`` added (columns of those names are replaced)."""
    return docs.withColumn("token_ids", token_ids(F.col(text), path, pattern)).withColumn("n_tokens", F.size("token_ids").cast("long"))
