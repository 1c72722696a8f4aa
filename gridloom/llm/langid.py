"""Language identification by bit-sliced Bloom filters over letter n-grams.

Each language has a Bloom filter of the n-grams that are usual in it. The
filters share their hash positions and are stored as one table of bit masks, a
bit a language, so the masks at an n-gram's positions, combined by AND, give all
the languages that contain it. Over a whole text the bits are counted by
language, each count is corrected for the filter's false positives, and the
largest corrected count decides.

Cases: a null text, or one without a letter, is ``und`` with score 0; a text
whose n-grams no filter holds gets the commonest learned language with score 0;
ties go to the commoner language, then to the earlier code; without any
training row every text is ``und``. Equal rows get equal answers; very long texts
are read whole, piece by piece; columns called as the results are replaced, all
others pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

UNDETERMINED = "und"
GRAMS = (2, 3, 4)
#: Letters that are looked at together; a longer text is worked through in such pieces.
PIECE = 1 << 18
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
STEP = np.uint64(0x100000001B3)

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def codes(text: str) -> np.ndarray:
    """The lower-cased text's letters by code point, all else as 0, with a 0 at either end."""
    points = np.frombuffer(f"\0{text.lower()}\0".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(letters()[points], points, 0).astype(np.uint32)


def grams(points: np.ndarray, begins: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the n-grams that begin in the first ``begins`` places; a 0 stands only at an n-gram's ends."""
    wide = points.astype(np.uint64)
    letter = points != 0
    places, hashes = [], []
    h, inner = wide, None
    for n in range(2, max(GRAMS) + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] * STEP) ^ (wide[n - 1 :] + np.uint64(n))
        inner = letter[1 : len(points) - n + 2] if n == 3 else (inner[: len(points) - n + 1] & letter[n - 2 : len(points) - 1] if n > 3 else letter[: len(points) - 1] | letter[1:])
        if n in GRAMS:
            at = np.flatnonzero(inner[:begins])
            places.append(at)
            hashes.append(h[at] * MIX[n % len(MIX)] ^ (h[at] >> np.uint64(29)))
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, text number of each place, places to begin at): short texts together, long ones piece by piece."""
    more = max(GRAMS) - 1
    held, owners, size = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        points = codes(text)
        if len(points) <= PIECE:
            held.append(points)
            owners.append((k, len(points)))
            size += len(points)
        else:
            for at in range(0, len(points), PIECE):
                part = points[at : at + PIECE + more]
                yield part, np.full(len(part), k), min(PIECE, len(part))
        if size >= PIECE:
            yield np.concatenate(held), np.repeat(*map(np.array, zip(*owners, strict=True))), size
            held, owners, size = [], [], 0
    if held:
        yield np.concatenate(held), np.repeat(*map(np.array, zip(*owners, strict=True))), size


@dataclass
class Filters:
    """langs: the commonest first. table: bit masks, a 64-bit word or less for every 64 languages."""

    langs: list[str]
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.uint8))
    hashes: int = 2

    def positions(self, h: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - (len(self.table) - 1).bit_length())
        return [((h ^ (h >> np.uint64(31))) * MIX[k]) >> shift for k in range(self.hashes)]

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits."""
        first, *rest = self.positions(h)
        found = self.table[first]
        for p in rest:
            found &= self.table[p]
        return found

    def false_rates(self) -> np.ndarray:
        word = self.table.dtype.itemsize * 8
        fill = [np.count_nonzero(self.table[:, k // word] >> self.table.dtype.type(k % word) & self.table.dtype.type(1)) / len(self.table) for k in range(len(self.langs))]
        return np.array(fill) ** self.hashes

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, n-grams that each language contains)."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        word = self.table.dtype.itemsize * 8
        for points, owner, begins in pieces(texts):
            at, h = grams(points, begins)
            who = owner[at]
            total += np.bincount(who, minlength=len(texts))
            found = self.masks(h)
            for k in range(len(self.langs)):
                has = (found[:, k // word] >> found.dtype.type(k % word) & found.dtype.type(1)).astype(bool)
                hits[:, k] += np.bincount(who[has], minlength=len(texts))
        return total, hits

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, hits = self.counts(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rate = self.false_rates()
        sure = np.maximum(0, (hits - total[:, None] * rate) / np.maximum(1e-9, 1 - rate))
        best = sure.argmax(axis=1)
        score = np.where(total > 0, sure[np.arange(len(texts)), best] / np.maximum(total, 1), 0).clip(0, 1)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, total, strict=True)], score


def build(langs: list[str], lang_of: np.ndarray, gram: np.ndarray, n: np.ndarray, *, least: float = 2e-6, part: float = 0.2, bits: int = 14, hashes: int = 2) -> Filters:
    """Filters from n-gram counts.

    An n-gram belongs to a language if it makes up at least ``least`` of the language's
    n-grams, and at least ``part`` of the share it has where it is most usual, which
    keeps passages in another language from leaking. bits: table places a stored n-gram.
    """
    totals = np.bincount(lang_of, n, len(langs))
    share = n / totals[lang_of]
    values, inverse = np.unique(gram, return_inverse=True)
    most = np.zeros(len(values))
    np.maximum.at(most, inverse, share)
    kept = (share >= least) & (share >= part * most[inverse])
    largest = max(np.bincount(lang_of[kept], minlength=len(langs)), default=1)
    size = 1 << max(12, int(bits * largest - 1).bit_length())
    kind = next(t for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(langs) <= w or w == 64)
    word = kind().itemsize * 8
    found = Filters(langs, np.zeros((size, -(-len(langs) // word)), kind), hashes)
    for k in range(len(langs)):
        for p in found.positions(gram[kept & (lang_of == k)]):
            found.table[p, k // word] |= kind(1 << k % word)
    return found


def learn(docs: DataFrame, allowed: Column, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 2000) -> Filters:
    """Filters from about ``max_docs`` whole texts a language, drawn by a hash of their ids; rarer languages give all they have.

    The n-grams of the drawn texts are counted where the texts are and summed by Spark.
    """
    spark = ready(docs.sparkSession)
    usable = docs.select(F.col(id_col), F.col(text).alias("_text"), F.col(lang).alias("_lang")).filter(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & allowed)
    common = sorted(usable.groupBy("_lang").count().collect(), key=lambda r: (-r["count"], r["_lang"]))
    langs = [r["_lang"] for r in common]
    if not langs:
        return Filters([])
    rates = F.create_map(*(x for r in common for x in (F.lit(r["_lang"]), F.lit(min(1.0, max_docs / r["count"])))))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    drawn = usable.filter(draw < rates[F.col("_lang")]).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for code, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(code, []).append(t)
            for code, texts in by.items():
                h = np.concatenate([np.zeros(0, np.uint64), *(grams(points, begins)[1] for points, _, begins in pieces(texts))])
                values, n = np.unique(h, return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array([code] * len(values)), pa.array(values.view(np.int64)), pa.array(n)], names=["_lang", "gram", "n"])

    number = F.create_map(*(x for k, code in enumerate(langs) for x in (F.lit(code), F.lit(k))))
    summed = drawn.mapInArrow(count, "_lang string, gram long, n long").groupBy("_lang", "gram").agg(F.sum("n").alias("n")).select(number[F.col("_lang")].alias("k"), "gram", "n")
    table = summed.toArrow()
    return build(langs, table.column("k").to_numpy(), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy())


def predict(df: DataFrame, filters: Filters, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with each whole text's language and its share of n-grams that the language contains."""
    spark = ready(df.sparkSession)
    sent = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = sent.value.decide(batch.column(batch.schema.get_field_index(text)).to_pylist())
            keep = [(n, batch.column(k)) for k, n in enumerate(batch.schema.names) if n not in (lang_out, score_out)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), pa.array(found, pa.string()), pa.array(score)], names=[*(n for n, _ in keep), lang_out, score_out])

    kept = [f for f in df.schema.fields if f.name not in (lang_out, score_out)]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))
