"""Byte-level BPE with a contiguous rank array.

A short word is held as an array of part boundaries with the merge rank of
every adjacent pair beside it. The smallest rank is found by a scan, its inner
boundary is deleted, and the ranks of the two neighbouring pairs are looked up
again, until no pair has a rank. Words beyond ``LONG_WORD`` bytes get the same
merges in the same order from a heap over linked parts, so a text without any
white space costs n log n instead of n squared. Every word is merged once a
worker and kept in a bounded memo.

Cases: a null text encodes as an empty one; strings of special tokens inside a
text become those tokens, as the tokenizers library does unless told otherwise;
ids that are not in the vocabulary decode to nothing; byte sequences that are
not UTF-8 decode with replacement characters; null ids decode to null. Equal rows give
equal rows; very long texts are coded whole; a column called as the result is replaced,
all others pass through; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ready

LONG_WORD = 96
MEMO_WORDS = 120_000
NO_RANK = 1 << 60

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def visible_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print in Latin-1 stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


def packed(ids: list[int], dtype: str = "<u4") -> bytes:
    """ids as little-endian unsigned integers, of 32 bits unless told otherwise."""
    flat = array("I" if dtype == "<u4" else "H", ids)
    if sys.byteorder == "big":
        flat.byteswap()
    return flat.tobytes()


class Memo(dict):
    """Packed ids by word; merges a word that isn't known yet, and starts anew when full."""

    def __init__(self, codec: ByteBPE):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        if len(raw) > LONG_WORD:
            return packed(self.codec.merge_long(raw), self.codec.dtype)
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = self[word] = packed(self.codec.merge_short(raw), self.codec.dtype)
        return ids


class ByteBPE:
    """Encoder and decoder for one vocabulary in the tokenizers library's JSON."""

    def __init__(self, document: str, dtype: str = "<u4"):
        spec, self.dtype = json.loads(document), dtype
        model, visible = spec["model"], visible_bytes()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ids = model["vocab"]
        as_bytes = lambda token: bytes(visible[c] for c in token)
        size = max([*ids.values(), *self.special.values()]) + 1
        self.of_id: list[bytes] = [b""] * size
        for token, i in ids.items():
            if token not in self.special:
                self.of_id[i] = as_bytes(token)
        for token, i in self.special.items():
            self.of_id[i] = token.encode()
        self.byte_id = [0] * 256
        for char, b in visible.items():
            self.byte_id[b] = ids[char]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault(ids[left] << 32 | ids[right], r)
            self.made.append(ids[left + right])
        self.words = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_ids = {t: packed([i], dtype) for t, i in self.special.items()}
        self.memo = Memo(self)

    def merge_short(self, word: bytes) -> list[int]:
        """ids of a word by the rank array."""
        parts = [self.byte_id[b] for b in word]
        bounds = list(range(len(word) + 1))
        rank, made = self.rank, self.made
        ranks = [rank.get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del bounds[i + 1], parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 32 | parts[i], NO_RANK)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges in the same order, for words where scans would be quadratic."""
        parts = [self.byte_id[b] for b in word]
        n, rank = len(parts), self.rank
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i] = self.made[r]
            gone[j] = 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get(parts[i] << 32 | parts[k])) is not None:
                    heapq.heappush(heap, (q, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (q := rank.get(parts[h] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (q, h, parts[h], parts[i]))
        return [p for p, dead in zip(parts, gone, strict=True) if not dead]

    def encode_ordinary(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.words.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """The text's ids, packed."""
        if not text:
            return b""
        if self.cut is None:
            return self.encode_ordinary(text)
        cut = self.cut.split(text)
        if len(cut) == 1:
            return self.encode_ordinary(text)
        return b"".join(self.special_ids[piece] if k % 2 else self.encode_ordinary(piece) for k, piece in enumerate(cut))

    def decode(self, ids) -> str:
        table, size = self.of_id, len(self.of_id)
        return b"".join(table[i] for i in ids if 0 <= i < size).decode("utf-8", "replace")


_LOADED: dict[tuple[int, str], ByteBPE] = {}


def loaded(document, dtype: str = "<u4") -> ByteBPE:
    """The codec of a broadcast vocabulary, built once a worker."""
    key = (hash(document.value), dtype)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(document.value, dtype)
    return _LOADED[key]


def vocabulary(spark, path: str):
    """A vocabulary file, read by the driver and broadcast; its size is fixed, whatever the corpus is."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [(n, batch.column(k)) for k, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(c for _, c in keep), values], names=[*(n for n, _ in keep), name])


def _plus(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, vocab_path: str, text: str = "text", out: str = "ids", *, special: bool = True, dtype: str = "<u4") -> DataFrame:
    """df and ``out``: the whole text's ids as packed little-endian unsigned integers.

    special: whether special tokens' strings in a text become those tokens. dtype: the
    integers' width; "<u2" holds vocabularies of up to 65,536 ids.
    A column already called ``out`` is replaced.
    """
    spark = ready(df.sparkSession)
    document = vocabulary(spark, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(document, dtype)
        one = codec.encode if special else lambda t: codec.encode_ordinary(t) if t else b""
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            yield _with(batch, out, pa.array((one(t.as_py()) for t in texts), pa.binary()))

    return df.mapInArrow(run, _plus(df, out, T.BinaryType()))


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and ``out``: the text that packed ids stand for, special tokens included."""
    spark = ready(df.sparkSession)
    document = vocabulary(spark, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(document)
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids))
            yield _with(batch, out, pa.array((None if (b := p.as_py()) is None else codec.decode(np.frombuffer(b, "<u4").tolist()) for p in packed), pa.string()))

    return df.mapInArrow(run, _plus(df, out, T.StringType()))
