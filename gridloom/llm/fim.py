"""Fill-in-the-middle: a text is cut twice, and its middle moves to the end behind markers.

The Split pre-tokenizer of the tokenizers library, with isolated matches of a
unit's pattern, gives each unit's offsets in code points; nothing is trained. The
length of the offset array is the number of units n, and the two cuts are the
offsets of the ranks that the document's hash asks for. The hash alone decides
the form and both ranks, so reruns agree wherever a row is read. Every row is
worked on by itself, without a shuffle.

The unit of the contract is a code point. Its offsets are looked up in two levels:
matches of ``WIDTH`` code points give the offsets of whole blocks, and matches of one
give those inside the blocks that hold the end of the text or a cut, so the library
makes a match a block and not one a code point. Texts are matched in pieces of
``PIECE`` code points, whose offsets are stitched, so that it never holds more than one
piece. Other units (lines, words) are matched on the whole text, one by one; what lies
between two matches is a unit, too.

Cases: null and empty texts have no units and stay plain; so do texts that hold a
marker, as they couldn't be told apart from transformed ones. Both cuts may fall
on one place or on an end, which leaves parts empty. A null id is hashed as an
empty one. Rows with equal ids are cut at the same fractions, and equal rows give
equal rows. Very long texts are cut whole. Columns called as the results are
replaced, all others pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from .common import ready, unused

CODE_POINT = r"[\s\S]"
WIDTH, PIECE = 128, 1 << 16
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Markers:
    """What stands before each part; none may begin as another ends, so that parts are told apart."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


MARKERS = Markers()


class Cutter:
    """Ranks of a text's units and their offsets, in code points."""

    def __init__(self, unit: str = CODE_POINT):
        of = lambda pattern: pre_tokenizers.Split(Regex(pattern), behavior="isolated").pre_tokenize_str
        self.split, self.single = of(unit), unit == CODE_POINT
        self.blocks = of(f"{CODE_POINT}{{1,{WIDTH}}}") if self.single else self.split

    @staticmethod
    def begins(split, text: str) -> np.ndarray:
        """Where each match begins."""
        matches = split(text) if text else []
        return np.fromiter((span[0] for _, span in matches), np.int64, len(matches))

    def offsets(self, text: str) -> np.ndarray:
        """Where each block of units begins; a block is a unit where units aren't code points."""
        step = PIECE if self.single else max(1, len(text))
        parts = [self.begins(self.blocks, text[at : at + step]) + at for at in range(0, len(text), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def cut(self, text: str, first: int, second: int) -> tuple[int, int, int]:
        """(units, where the prefix ends, where the middle ends) for two hashes."""
        ends = np.append(self.offsets(text), len(text))
        blocks = len(ends) - 1
        inside = lambda k: self.begins(self.split, text[ends[k] : ends[k + 1]]) + ends[k]
        n = blocks if blocks == 0 or not self.single else (blocks - 1) * WIDTH + len(inside(blocks - 1))
        at = lambda rank: ends[rank] if not self.single else len(text) if rank == n else inside(rank // WIDTH)[rank % WIDTH]
        low, high = sorted((first % (n + 1), second % (n + 1)))
        return n, int(at(low)), int(at(high))


def rearranged(text: str, form: str, low: int, high: int, markers: Markers = MARKERS) -> str:
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if form == PSM:
        return f"{markers.prefix}{prefix}{markers.suffix}{suffix}{markers.middle}{middle}"
    if form == SPM:
        return f"{markers.suffix}{suffix}{markers.prefix}{prefix}{markers.middle}{middle}"
    return text


def draws(id_col: str, seed: str) -> list[Column]:
    """The first four 8-digit groups of the seeded id's hash, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


RESULTS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
])


def transform(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    out: str = "output",
    *,
    plain_from: int = 90,
    spm_below: int = 20,
    seed: str = "1",
    unit: str = CODE_POINT,
    markers: Markers = MARKERS,
) -> DataFrame:
    """df with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``out``.

    plain_from, spm_below: of a hundred texts, those from the first number on stay
    plain, and of the others as many as the second number put the suffix first. ``out``
    may be the text column itself, which is replaced then.
    """
    ready(df.sparkSession)
    h1, h2, h3, h4 = draws(id_col, seed)
    body = F.coalesce(F.col(text), F.lit(""))
    marked = F.greatest(*(F.contains(body, F.lit(m)).cast("int") for m in markers.all)) == 1
    form = F.when((body == "") | marked | (h3 % 100 >= plain_from), PLAIN).when(h4 % 100 < spm_below, SPM).otherwise(PSM)
    result = [*RESULTS.names, out]
    passed = [c for c in df.columns if c.lower() not in {r.lower() for r in result}]
    whole, kind, low, high = (unused(df, name) for name in ("_whole", "_kind", "_low", "_high"))
    ask = df.select(*passed, body.alias(whole), form.alias(kind), h1.alias(low), h2.alias(high))
    schema = T.StructType([*(df.schema[c] for c in passed), *RESULTS.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(unit)
        for batch in batches:
            kept = batch.columns[: len(passed)]
            texts, forms, firsts, seconds = batch.columns[len(passed) :]
            rows = []
            for t, f, a, b in zip(texts, forms.to_pylist(), firsts.to_pylist(), seconds.to_pylist(), strict=True):
                t = t.as_py()
                n, x, y = cutter.cut(t, a, b)
                told = (None, None) if f == PLAIN else (x, y - x)
                rows.append((n, f, *told, rearranged(t, f, x, y, markers)))
            made = zip(*rows, strict=True) if rows else [()] * len(result)
            arrays = [pa.array(v, k) for v, k in zip(made, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=schema.names)

    return ask.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", markers: Markers = MARKERS) -> Column:
    """The text that an output of a form was made of; the markers before its parts are the only ones in it."""
    parts = F.split(F.col(output), "|".join(rf"\Q{m}\E" for m in markers.all), -1)
    rebuilt = {PSM: (1, 3, 2), SPM: (2, 3, 1)}
    at = {f: F.concat(*(F.get(parts, F.lit(k)) for k in order)) for f, order in rebuilt.items()}
    return F.when(F.col(form) == PSM, at[PSM]).when(F.col(form) == SPM, at[SPM]).otherwise(F.col(output))
