"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised straight from a rank file: every token's bytes are
mapped to printable characters, a piece's score is its negative rank, and the
normaliser is the identity, so sentencepiece merges the pair of lowest rank,
leftmost first. Texts are cut into pre-tokens and each pre-token is encoded on
its own; a bounded cache per worker holds pre-tokens already encoded. Decoding
maps pieces back to bytes. The work is a narrow map over the documents: nothing
is shuffled, and the model (a file of fixed size) is the only thing broadcast.

Defined results: null and empty texts have no ids and decode to no bytes; a
pre-token that is itself a token is that token; rows that repeat an id, or have
none, are encoded each; an empty table has no rows; a very long text is encoded
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake.llm.common import id_and_text

#: Texts whose ids a task holds at a time.
SLICE = 200
#: Pre-tokens that one worker remembers before it starts anew.
CACHE = 100_000
#: Longest pre-token worth remembering.
CACHE_CHARS = 40


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def build_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the id after the last is <unk>."""
    chars, unk = byte_chars(), max(ranks.values()) + 1
    by_id = {rank: "".join(chars[b] for b in token) for token, rank in ranks.items()}
    pieces = b"".join(
        # a gap in the ranks is filled by a piece that no text can reach (type 5: unused)
        _field(1, _field(1, by_id.get(i, f"<gap{i}>").encode()) + _field(2, float(-i)) + _field(3, 1 if i in by_id else 5))
        for i in range(unk)
    )
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # trainer: BPE, size, unk/bos/eos/pad ids; normaliser: identity without any white space rule
    trainer = _field(3, 2) + _field(4, unk + 1) + _field(40, unk) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        chars = byte_chars()
        self.to_chars = {b: chars[b] for b in range(256)}
        back = {c: b for b, c in enumerate(chars)}
        self.unk = self.pieces.unk_id()
        names = [self.pieces.id_to_piece(i) for i in range(self.unk)]
        self.bytes_of = [b"" if self.pieces.is_unused(i) else bytes(back[c] for c in name) for i, name in enumerate(names)]
        self.whole = {name: i for i, name in enumerate(names)}
        self.cache: dict[str, list[int]] = {}

    def _learn(self, pretokens: list[str], into: dict[str, list[int]]) -> None:
        mapped = [p.encode().decode("latin-1").translate(self.to_chars) for p in pretokens]
        for p, m, ids in zip(pretokens, mapped, self.pieces.encode(mapped, out_type=int, num_threads=1), strict=True):
            into[p] = [self.whole[m]] if m in self.whole else ids

    def encode(self, text: str) -> np.ndarray:
        pretokens = self.cut(text)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        unknown = [p for p in dict.fromkeys(pretokens) if p not in cache]
        known = cache
        if unknown:
            long = [p for p in unknown if len(p) > CACHE_CHARS]
            self._learn([p for p in unknown if len(p) <= CACHE_CHARS], cache)
            if long:
                own: dict[str, list[int]] = {}
                self._learn(long, own)
                return np.fromiter(chain.from_iterable(own.get(p) or cache[p] for p in pretokens), np.int32)
        return np.fromiter(chain.from_iterable(map(known.__getitem__, pretokens)), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class ByteBpe:
    """Column functions over one vocabulary: ``encode(text) -> array<int>``, ``decode(ids) -> binary``."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        shared = spark.sparkContext.broadcast((build_model(read_ranks(path)), pattern))

        @F.pandas_udf("array<int>")
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = Codec(*shared.value)
            for batch in texts:
                yield pd.Series([codec.encode(t or "") for t in batch])

        @F.pandas_udf("binary")
        def decode(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = Codec(*shared.value)
            for batch in lists:
                yield pd.Series([codec.decode(ids.tolist() if ids is not None else ()) for ids in batch])

        self._encode, self._decode = encode, decode

    def encode(self, text: Column | str) -> Column:
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        return self._decode(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document: encoded, and decoded from the ids, in one pass over Arrow batches, ``SLICE`` rows at a time."""
    shared = docs.sparkSession.sparkContext.broadcast((build_model(read_ranks(path)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                decoded = pa.array([codec.decode(i.tolist()) for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), decoded], ["doc_id", "ids", "decoded"])

    rows = id_and_text(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what :func:`encode_documents` returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
