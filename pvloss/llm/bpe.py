"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte stands for one character (U+0100 + byte), so every token of the vocabulary becomes a
piece of such characters. Its score is its negative rank: sentencepiece then merges the adjacent
pair of lowest rank first, the leftmost on ties, as the rank file asks. Normalisation is identity.
Each pre-token (a match of the pattern) is encoded on its own; decoding maps ids back to pieces and
pieces back to bytes.

Defined cases: a null text counts as empty and gives no ids; ids that are null give null bytes;
repeated rows stay; further input columns are ignored; the vocabulary must hold all 256 bytes and
ranks 0..n-1 without holes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import UnitStore, ragged

FIRST = 0x100  # the character of byte 0
_TO_CHAR = {i: FIRST + i for i in range(256)}
SLICE = 1 << 21  # bytes of text that are encoded at a time


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _int(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int(3, kind))


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHAR)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks aren't 0..{len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece i is token i, the unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_piece(as_chars(t), -float(i), normal) for i, t in enumerate(tokens)] + [_piece("<unk>", 0.0, unknown)]
    trainer = _int(3, bpe) + _int(4, len(pieces))
    # name, no dummy prefix, extra white space kept, white space not escaped
    normalizer = _message(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normalizer)


class Codec:
    """Encodes and decodes with one vocabulary; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.find = regex.compile(pattern).findall
        back = {FIRST + i: i for i in range(256)}
        of_id = [bytes(back[ord(c)] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        self.bytes, self.sizes = np.frombuffer(b"".join(of_id), np.uint8), np.fromiter(map(len, of_id), np.int64, len(of_id))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.units = UnitStore(self._encode_units, np.uint32, 200_000)

    def pre_tokens(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode([as_chars(p.encode()) for p in pieces], num_threads=1) if pieces else []

    def split(self, texts: list[str], inner: bool) -> list[list[str]]:
        """The pre-tokens of texts, or of units that lack the space before them."""
        return [self.find(" " + t) for t in texts] if inner else [self.find(t) for t in texts]

    def _encode_units(self, texts: list[str], inner: bool) -> tuple[np.ndarray, np.ndarray]:
        split = self.split(texts, inner)
        ids = self.pre_tokens([p for s in split for p in s])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array) -> pa.Array:
        """texts (no nulls) -> for each its ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.units.many(texts)
        return binary(ids.astype("<u4"), ends)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The inverse of encode, as bytes."""
        flat = np.concatenate([np.empty(0, "<u4"), *[np.frombuffer(x, "<u4") for x in ids.to_pylist() if x]])
        out, token_ends = ragged(self.bytes, self.starts, self.sizes, flat)
        of_text = np.cumsum(pc.fill_null(pc.binary_length(ids), 0).to_numpy().astype(np.int64)) // 4
        return binary(out, np.concatenate([[0], token_ends])[of_text], ids.is_null())


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def binary(values: np.ndarray, ends: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    """Runs of values, given by where each ends, as a binary array."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return (out if null is None else pc.if_else(null, None, out)).cast(pa.binary())


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that hold about `most` bytes each; one row at least."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def _encoded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big, "text"):
            ids = own.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pc.divide(pc.binary_length(ids), 4).cast(pa.int64())], names=["doc_id", "ids", "n_tokens"])


def _decoded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big, "ids"):
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode(batch.column("ids"))], names=[*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens."""
    rows, kind = _texts(docs, id_col, text_col)
    return rows.mapInArrow(lambda batches: _encoded(codec(path, pattern), batches), f"doc_id {kind}, ids binary, n_tokens bigint")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, ids, n_tokens) -> the same with decoded (binary) added."""
    rows = encoded.select("doc_id", "ids", "n_tokens")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens bigint, decoded binary"
    return rows.mapInArrow(lambda batches: _decoded(codec(path, pattern), batches), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass, so that a task has one Python worker and one vocabulary."""
    rows, kind = _texts(docs, id_col, text_col)

    def run(batches):
        own = codec(path, pattern)
        return _decoded(own, _encoded(own, batches))

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint, decoded binary")
