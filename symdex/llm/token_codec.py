"""Operator 7: byte-level BPE through a sentencepiece model that is serialised straight from a rank table.

Each byte is a letter of its own (the code point of that number), each vocabulary entry a piece of such letters whose
score is its negated rank, the normaliser is the identity. Merging the best-scored neighbour pair, leftmost
first, is then the same as merging the lowest rank. A text is cut by the tokenizer's pattern, each part is
encoded alone; decoding looks the ids' bytes up. Parts that are vocabulary entries are taken whole.

Null text counts as empty; an empty text has no ids. Repeated rows give repeated results, an empty table an
empty one; other columns of the input are not looked at, whatever their names. Lone surrogates can't occur in
Spark strings. The rank table's path and the pattern are parameters.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from symdex.llm.shared import keyed, map_texts, table, texts_of

#: Bounds on remembered parts of texts per worker and on their characters; beyond one the memory starts anew (results are the same).
CACHE_PARTS, CACHE_CHARS = 400_000, 8 << 20


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in the order of their ranks, which must run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes((n & 127 | 128,)), n >> 7
    return out + bytes((n,))


def _field(number: int, payload: bytes | int | float) -> bytes:
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def letters(part: bytes) -> str:
    """Byte b as the letter U+0000 + b, but U+0100 for 0, which pieces can't hold. No piece holds the word mark U+2581, so nothing in it has another meaning."""
    return part.decode("latin-1").replace("\0", "\u0100")


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (field 1), trainer (2) and normaliser settings (3).

    The unknown piece that the format asks for comes last, so that a piece's id is its rank.
    """
    pieces = [_field(1, _field(1, letters(x).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, x in enumerate(vocabulary)]
    pieces.append(_field(1, _field(1, "\u2047".encode()) + _field(2, float(-len(vocabulary))) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(24, 0) + _field(35, 0) + _field(40, len(vocabulary)) + _field(45, "\u2047".encode()) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one rank table."""

    def __init__(self, vocabulary: list[bytes], pattern: str, cache_parts: int = CACHE_PARTS):
        import regex
        import sentencepiece

        self.vocabulary, self.cache_parts, self.held = vocabulary, cache_parts, 0
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(vocabulary))
        self.parts_of = regex.compile(pattern).findall
        self.whole = {x: struct.pack("<I", i) for i, x in enumerate(vocabulary)}
        self.cache: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> None:
        self.held += sum(map(len, parts))
        raws = [p.encode() for p in parts]
        known = list(map(self.whole.get, raws))
        self.cache.update((p, k) for p, k in zip(parts, known, strict=True) if k is not None)
        rest = [(p, raw) for p, raw, k in zip(parts, raws, known, strict=True) if k is None]
        ids = self.model.encode([letters(raw) for _, raw in rest], num_threads=1) if rest else []
        self.cache.update((p, array("I", x).tobytes()) for (p, _), x in zip(rest, ids, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if len(self.cache) > self.cache_parts or self.held > CACHE_CHARS:
                self.cache.clear()
                self.held = 0
            parts = self.parts_of(text)
            found = list(map(self.cache.get, parts))
            if None in found:
                self._learn({p for p, x in zip(parts, found, strict=True) if x is None})
                found = map(self.cache.__getitem__, parts)
            out.append(b"".join(found))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _maker(path: str, pattern: str) -> Callable[[], ByteBpe]:
    def make() -> ByteBpe:
        if (path, pattern) not in _made:
            _made[path, pattern] = ByteBpe(read_ranks(path), pattern)
        return _made[path, pattern]

    return make


_made: dict[tuple[str, str], ByteBpe] = {}


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids array<int>) for each row: the ids themselves, for training files."""
    known = default_tokenizer()
    get = _maker(path or known[0], pattern or known[1])

    def make():
        codec = get()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode(texts_of(batch, "text"))
            return pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], ["key", "ids"])

        return each

    return map_texts(df.select(df[key].alias("key"), df[text].alias("text")), "text", make, keyed(df, key, "ids array<int>")).withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, text binary): the bytes that the ids stand for; null ids give empty bytes."""
    known = default_tokenizer()
    get = _maker(path or known[0], pattern or known[1])

    def run(batches):
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or get().vocabulary
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [b"".join(map(vocabulary.__getitem__, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["key", "text"])

    return df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, keyed(df, key, "text binary")).withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text, digests of the ids and of their decoding; on request the ids too."""
    known = default_tokenizer()
    get = _maker(path or known[0], pattern or known[1])
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def make():
        codec = get()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode(texts_of(batch, "text"))
            digest = [hashlib.sha256(x).hexdigest() for x in ids]
            decoded = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *[_lists(ids)] * with_ids], names)

        return each

    schema = keyed(df, key, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return map_texts(df.select(df[key].alias("key"), df[text].alias("text")), "text", make, schema).withColumnRenamed("key", key)


def op7_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
