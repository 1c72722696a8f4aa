"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

A detector has a pattern, a check that a match must pass, a prior score, and words
that raise the score when one stands within ``WINDOW`` code points of the span.
Spans that reach ``least`` are found. Four base kinds reach it by themselves:
email, ip, card (Luhn) and phone. Others are added to them, and never take one of
them away: cards inside longer runs of digits that fail as a whole, account
numbers (IBAN, mod 97), and, where a word nearby speaks for them, national
telephone numbers, social security numbers (US), insurance numbers (FR, mod 97)
and identity numbers (ES, mod 23). An added span must stand free of letters and
digits, is left out where a base span covers it or a better added one overlaps it (a higher
score, then a longer span, then the first).

Patterns of the base kinds give what the contract's patterns give, but never try
a place twice: an address is read from its @ outwards, and runs of digits are
taken whole, so that long runs cost linear time. Every row is worked on by itself,
without a shuffle.

Cases: null and empty texts have no spans. Very long texts are read whole. Offsets
are code points, ends are exclusive. Equal rows give equal rows; ids aren't read.
A column called as the result is replaced, all others pass through; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

LEAST = 0.5
#: Code points on each side of a span in which words speak for it, and what one of them adds.
WINDOW, NEARBY = 40, 0.3
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Length of an account number by country (ISO 13616).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# Check letters of Spanish identity numbers, by the number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    """Whether a number's digits, every second one from the right doubled, sum up to a multiple of ten."""
    total = sum(map(int, number[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])
    return total % 10 == 0


def is_card(match: str) -> bool:
    number = digits(match)
    return 12 <= len(number) <= 19 and luhn(number)


def is_ip(match: str) -> bool:
    """Parts are at most 255, whatever zeros lead them."""
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def is_phone(match: str) -> bool:
    return 9 <= len(digits(match)) <= 15


def is_iban(match: str) -> bool:
    """Whether the number, its first four signs moved behind it and letters read as 10 to 35, is 1 modulo 97."""
    signs = match.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1


def is_ssn(match: str) -> bool:
    area, group, serial = match.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_insurance(match: str) -> bool:
    number = match.replace(" ", "")
    return 97 - int(number[:13]) % 97 == int(number[13:])


def is_dni(match: str) -> bool:
    return match[-1] == DNI_LETTERS[int(match[:8]) % 23]


def iban_pattern() -> str:
    """Countries of one length together, each with as many signs as its length asks for."""
    by: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTH.items():
        by.setdefault(length, []).append(country)
    return "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by.items()))


@dataclass(frozen=True)
class Detector:
    kind: str
    pattern: str
    confirm: Callable[[str], bool]
    prior: float
    words: tuple[str, ...] = ()
    base: bool = False
    #: A sign that every match holds, looked for first.
    sign: str = ""


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PHONE_WORDS = ("phone", "telephone", "tel", "call", "fax", "mobile", "telefon", "handy", "mobil", "portable", "telefono", "movil", "fono")
DETECTORS = (
    Detector("email", EMAIL, bool, 0.9, ("email", "e-mail", "mail", "correo", "courriel"), base=True, sign="@"),
    Detector("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", is_ip, 0.5, ("ip", "host", "server", "address"), base=True),
    Detector("card", r"[0-9]++(?:[\x20-][0-9]++)*+", is_card, 0.7, ("card", "visa", "mastercard", "karte", "kreditkarte", "carte", "tarjeta"), base=True),
    Detector("phone", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, 0.6, PHONE_WORDS, base=True, sign="+"),
    Detector("card", r"[0-9]{12,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", is_card, 0.6, ("card", "visa", "mastercard", "karte", "kreditkarte", "carte", "tarjeta")),
    Detector("phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", is_phone, 0.3, PHONE_WORDS),
    Detector("iban", iban_pattern(), is_iban, 0.8, ("iban", "konto", "account", "compte", "cuenta")),
    Detector("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", is_ssn, 0.3, ("ssn", "social", "security")),
    Detector("insurance", r"[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}", is_insurance, 0.4, ("nir", "insee", "secu", "sociale", "vitale")),
    Detector("dni", r"[0-9]{8}[A-Z]", is_dni, 0.4, ("dni", "nif", "identidad", "documento")),
)
#: The order of kinds where spans begin at one place.
KINDS = tuple(dict.fromkeys(d.kind for d in DETECTORS))
SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("base", T.BooleanType()),
])
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def emails(text: str, domains=re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").finditer, local=re.compile(r"[^A-Za-z0-9._%+-]").search) -> Iterator[tuple[int, int]]:
    """Matches of ``EMAIL``: from an @ with a domain, back to where its local part or the last match ends."""
    done = 0
    for m in domains(text):
        stop = m.start()
        # Backwards in growing steps: a local part is short, and none is read twice.
        step, begin = 64, stop
        while begin > done:
            piece = text[max(done, begin - step) : begin][::-1]
            other = local(piece)
            begin -= other.start() if other else len(piece)
            if other:
                break
            step *= 2
        if begin < stop:
            yield begin, m.end()
            done = m.end()


class Finder:
    """Detectors with their compiled patterns."""

    def __init__(self, detectors: tuple[Detector, ...] = DETECTORS, least: float = LEAST):
        self.least, self.order = least, {k: i for i, k in enumerate(dict.fromkeys(d.kind for d in detectors))}
        spoken = lambda words: re.compile(r"(?a:\b)(?:" + "|".join(map(re.escape, words)) + r")(?a:\b)").search if words else None
        self.base, self.added = (
            [(d, re.compile(d.pattern).finditer, spoken(d.words)) for d in detectors if d.base is side] for side in (True, False)
        )

    def matched(self, d: Detector, finditer, text: str) -> Iterator[tuple[int, int]]:
        if d.sign not in text:
            return
        if d.pattern == EMAIL:
            yield from emails(text)
        else:
            for m in finditer(text):
                yield m.span()

    def scored(self, d: Detector, finditer, spoken, text: str) -> Iterator[tuple]:
        for start, end in self.matched(d, finditer, text):
            if not d.confirm(text[start:end]):
                continue
            beside = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".translate(LOWER)
            score = min(1.0, d.prior + (NEARBY if spoken and spoken(beside) else 0.0))
            if score >= self.least and (d.base or (not text[max(0, start - 1) : start].isalnum() and not text[end : end + 1].isalnum())):
                yield d.kind, start, end, score, d.base

    def spans(self, text: str | None) -> list[tuple]:
        """(kind, start, end, score, base) by start, then kind."""
        if not text:
            return []
        own = [s for d in self.base for s in self.scored(*d, text)]
        if ANY_DIGIT(text):
            added = [s for d in self.added for s in self.scored(*d, text)]
            # Base spans by start, with the furthest end so far: one covers a span if it began no later and ends no earlier.
            begins, furthest = [], []
            for _, start, end, _, _ in sorted(own, key=lambda s: s[1]):
                begins.append(start)
                furthest.append(max(end, furthest[-1] if furthest else 0))
            free = []
            for s in added:
                k = bisect_right(begins, s[1])
                if not (k and furthest[k - 1] >= s[2]):
                    free.append(s)
            own += apart(free)
        return sorted(own, key=lambda s: (s[1], self.order[s[0]], s[2]))


ANY_DIGIT = re.compile(r"[0-9]").search


def apart(spans: list[tuple]) -> list[tuple]:
    """The spans that no better one overlaps: better is the higher score, then the longer span, then the first."""
    better = lambda s: (s[3], s[2] - s[1], -s[1])
    beaten, open_spans = set(), []
    # Spans of one detector don't overlap, so only a few are open at a time.
    for s in sorted(spans, key=lambda s: s[1]):
        open_spans = [o for o in open_spans if o[2] > s[1]]
        for o in open_spans:
            beaten.add(min(s, o, key=better))
        open_spans.append(s)
    return [s for s in spans if s not in beaten]


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each span, or spans that overlap together, as the first one's kind in angle brackets."""
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(df: DataFrame, text: str = "text", out: str = "spans", *, mask: str | None = None, least: float = LEAST, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """df with ``out``, an array of (kind, start, end, score, base), and, if ``mask`` names a column, the text without them.

    ``mask`` may be the text column itself, which is replaced then; a null text stays null.
    """
    ready(df.sparkSession)
    gone = {c.lower() for c in (out, mask) if c}
    passed = [c for c in df.columns if c.lower() not in gone]
    fields = [T.StructField(out, T.ArrayType(SPAN)), *([T.StructField(mask, T.StringType())] if mask else [])]
    schema = T.StructType([*(df.schema[c] for c in passed), *fields])
    ask = df.select(*passed, F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(detectors, least)
        for batch in batches:
            texts, rows, clean = batch.columns[-1], [], []
            for t in texts:
                t = t.as_py()
                rows.append(finder.spans(t))
                if mask:
                    clean.append(None if t is None else masked(t, rows[-1]))
            found = pa.array([[dict(zip(ARROW_SPAN.names, s, strict=True)) for s in r] for r in rows], pa.list_(ARROW_SPAN))
            made = [found, pa.array(clean, pa.string())] if mask else [found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *made], names=schema.names)

    return ask.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
