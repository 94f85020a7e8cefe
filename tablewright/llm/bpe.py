"""Byte-level BPE over a ranked vocabulary, run by a sentencepiece model serialised straight from the ranks."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import carried, chunks, opened, released, whole_texts

SHIFT = 0x100
"""Byte b is written as code point 256 + b in the pieces, so every byte string is a text and back."""
CACHE_ENTRIES = 100_000
"""Pre-tokens whose ids a Python worker remembers; a full memory is emptied."""
_TO_PIECE = {b: chr(SHIFT + b) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``; the path is a parameter, the file is never copied."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One field in the protobuf wire format."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def to_piece(token: bytes) -> str:
    """The byte-mapped form of a byte string."""
    return token.decode("latin-1").translate(_TO_PIECE)


def from_piece(piece: str) -> bytes:
    """The inverse of ``to_piece``."""
    return bytes(ord(c) - SHIFT for c in piece)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, then a piece for each token in order of rank.

    A piece's score is its negative rank, so sentencepiece merges the pair of lowest rank first and the
    leftmost of equal ones, as rank-based BPE does. The normaliser is the identity without dummy
    prefix, white-space folding or escapes.
    """
    unknown, byte_pair, control = 2, 2, -1
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, to_piece(token)) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(2, _field(3, byte_pair) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, control) + _field(42, control) + _field(43, control)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        ordered = sorted(ranks.values())
        self.ids = [-1, *ordered]  # of each piece of the model
        self.packed = [b"", *(struct.pack("<I", i) for i in ordered)]
        self.single = {to_piece(t): struct.pack("<I", i) for t, i in ranks.items()}
        self.bytes_of = [b""] * (ordered[-1] + 1)
        for piece in range(1, self.model.get_piece_size()):
            self.bytes_of[self.ids[piece]] = from_piece(self.model.id_to_piece(piece))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; each pre-token is encoded separately."""
        parts = [self.split(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known = self.known
        missing = [t for t in set().union(*parts) if t not in known]
        todo = []
        for token in missing:
            piece = to_piece(token.encode())
            if (whole := self.single.get(piece)) is not None:  # a pre-token of the vocabulary is taken whole
                known[token] = whole
            else:
                todo.append((token, piece))
        packed = self.packed
        for (token, _), ids in zip(todo, self.model.encode([p for _, p in todo], num_threads=1) if todo else [], strict=True):
            known[token] = b"".join([packed[i] for i in ids])
        return [b"".join([known[t] for t in p]) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each Python worker."""
    return Codec(path, pattern)


PIECE_BYTES = 1 << 19


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, digest: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per row: ``doc_id``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded`` (binary, the ids' bytes: the text's UTF-8; with ``digest`` its SHA-256). Null and empty texts have no ids. Repeated rows
    and very long texts are encoded like any other; other columns are not read or, with ``carry``, passed through, the new
    ones taking the place of namesakes. There is no shuffle.
    ``path`` must be readable on the executors.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for ids, data, offsets in chunks(batches, PIECE_BYTES, text_col):
            raw = data.tobytes()
            marks = offsets.tolist()
            packed = own.encode([raw[a:b].decode() for a, b in zip(marks, marks[1:], strict=False)])
            decoded = (own.decode(p) for p in packed)
            back = [hashlib.sha256(x).digest() for x in decoded] if digest else list(decoded)
            yield pa.record_batch([ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = carried(docs, text_col) if carry else whole_texts(docs, id_col, text_col)
    kinds = {"doc_id": rows.schema["_id"].dataType, "n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.BinaryType()}
    found = rows.mapInArrow(released(work), T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
    return opened(found, "doc_id", ["n_tokens", "ids", "decoded"]) if carry else found


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's packed ids (``doc_id``, ``text``), one row per row.

    Null and empty ids give an empty text, also where doc_id is null; repeated rows are decoded alike and none is
    ordered before another; ids may be as long as a row can be; an empty table gives an empty result; other columns stay out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.decode(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(work, "doc_id long, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """Lengths and hashes of encoded rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def production() -> tuple[str, str]:
    """The vocabulary path and pre-token pattern of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return digests(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *production()))
