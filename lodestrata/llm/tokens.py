"""Encoding of a corpus with the byte-level BPE vocabulary of a public tokenizer (problem 8).

Method: the vocabulary is serialised straight into a sentencepiece BPE model. Each of the 256 bytes is mapped to
a printable character, a piece's score is its negative rank, normalisation is the identity. Texts are split into
pre-tokens by the vocabulary's pattern, each distinct pre-token of a worker is encoded once, and decoding is the
inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pre-tokens that a worker remembers; when full, the memory starts anew.
CACHE_ENTRIES = 400_000


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 characters stand for themselves, the rest from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, ints varint, floats 32 bit."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the id after the last is the unknown piece."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        text = "".join(chars[b] for b in token).encode()
        pieces[rank] = _field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, normal))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(ranks))
        self.split = regex.compile(pattern).findall
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        self.to_byte = {c: b for b, c in enumerate(chars)}
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = self.split
        parts = [split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = list({p for words in parts for p in words if p not in known})
        if new:
            mapped = [p.encode().decode("latin-1").translate(self.to_chars) for p in new]
            known.update(zip(new, self.model.encode(mapped)))
        return [[i for p in words for i in known[p]] for words in parts]

    def decode(self, ids: list[int]) -> str:
        text = "".join(self.model.id_to_piece(list(ids))) if len(ids) else ""
        return bytes(self.to_byte[c] for c in text).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str | None = None) -> ByteBpe:
    if pattern is None:
        pattern = word_pattern()
    return ByteBpe(path, pattern)


def word_pattern() -> str:
    """The splitting pattern of the vocabulary: contractions, words, numbers, signs, white space."""
    return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encode(frame: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``ids`` (array<int>) of each row's text; null and empty texts give an empty list.

    Special-token strings in a text are ordinary text. Rows are not moved, so nothing is shuffled.
    """
    return _encoded(frame, text, ids, path, keep, lengths=False)


def count_tokens(frame: DataFrame, text: str = "text", count: str = "n_tokens", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the number of ids of each row's text, 0 for null and empty texts."""
    return _encoded(frame, text, count, path, keep, lengths=True)


def _encoded(frame: DataFrame, text: str, out: str, path: str | None, keep: list[str] | None, lengths: bool) -> DataFrame:
    where = path or tokenizer_file()
    kept = [c for c in (frame.columns if keep is None else keep) if c != out]
    names = list(dict.fromkeys([*kept, text]))
    source = frame.select(*[f"`{c}`" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(where)
        for batch in batches:
            coded = bpe.encode_batch(batch.column(names.index(text)).to_pylist())
            sizes = [len(c) for c in coded]
            if lengths:
                column = pa.array(sizes, pa.int32())
            else:
                offsets = [0]
                for n in sizes:
                    offsets.append(offsets[-1] + n)
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([i for c in coded for i in c], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), column], [*kept, out])

    from pyspark.sql import types as T

    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(out, T.IntegerType() if lengths else T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, schema)
