"""Encoding a corpus with a public byte-level BPE vocabulary.

The vocabulary (a file of base64 tokens and ranks) is serialised directly into
a sentencepiece BPE model: each token's bytes are mapped to printable
characters, its score is the negative rank, and normalisation is the identity.
Texts are cut into pre-tokens by the vocabulary's own pattern, each distinct
pre-token is encoded once per worker, and ids are looked up after that.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most distinct pre-tokens a worker remembers; beyond that it starts afresh. It bounds memory, not results.
MEMORY = 400_000

_workers: dict[tuple[str, str], "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(1)
def byte_characters() -> tuple[str, ...]:
    """A printable character for each byte: itself where printable Latin-1, else the next code point from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in printable else chr(next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks must count up from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks of ``tokens``; the unknown piece gets the next id.

    Merging takes the adjacent pair of the highest score, that is of the
    lowest rank, leftmost first, as rank-based byte-pair encoding does.
    """
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, normal)) for rank, token in enumerate(tokens)]
    pieces.append(_field(1, _field(1, "<unk>".encode()) + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Encoder:
    """Encodes and decodes texts with a model made by ``sentencepiece_model``."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.back = {ord(c): b for b, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        for text in texts:
            if not text:
                yield []
                continue
            words = self.cut(text)
            fresh = list({w for w in words if w not in self.known})
            if fresh:
                if len(self.known) > MEMORY:
                    self.known.clear()
                    fresh = list(set(words))
                mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in fresh]
                self.known.update(zip(fresh, self.pieces.encode(mapped, out_type=int, num_threads=1)))
            ids: list[int] = []
            for w in words:
                ids += self.known[w]
            yield ids

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(self.pieces.id_to_piece(int(i)) for i in ids)
        return text.translate(self.back).encode("latin-1").decode("utf-8", "replace")


def _encoder(key: str, model: bytes, pattern: str) -> Encoder:
    if (key, pattern) not in _workers:
        _workers[key, pattern] = Encoder(model, pattern)
    return _workers[key, pattern]


def _setup(df: DataFrame, vocabulary: str | None, pattern: str | None):
    path = vocabulary or default_vocabulary()
    # The model's size is fixed by the vocabulary (about 1 MB), whatever the corpus.
    model = df.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(path)))
    return path, model, pattern or default_pattern()


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(key, ids array<int>)`` of every row, without special tokens.

    Null and empty texts give an empty list; texts of any length are encoded
    whole; rows repeated in ``df`` stay repeated; other columns are dropped.
    The vocabulary file is read on the driver only.
    """
    path, model, pattern = _setup(df, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, model.value, pattern)
        for batch in batches:
            ids, ends = [], [0]
            for one in encoder.encode(batch.column(1).to_pylist()):
                ids += one
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keep_columns: list[str], text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep_columns`` and ``n_tokens int`` of every row; the ids themselves never leave the worker."""
    path, model, pattern = _setup(df, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, model.value, pattern)
        for batch in batches:
            sizes = [len(one) for one in encoder.encode(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32())], names=[*names, "n_tokens"])

    names = [f"c{i}" for i in range(len(keep_columns))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep_columns, names)], F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.IntegerType())])
    return rows.mapInArrow(run, schema).toDF(*keep_columns, "n_tokens")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(key, text)`` of every row: the inverse of ``encode_texts``; a null or empty list gives an empty text."""
    path, model, pattern = _setup(df, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, model.value, pattern)
        for batch in batches:
            texts = [encoder.decode(one or []) for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
