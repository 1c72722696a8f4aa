import hashlib
import random
import re
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import pii, queries

# The contract's patterns, read literally.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    number = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(number))]
        return 12 <= len(number) <= 19 and sum(doubled) % 10 == 0
    return 9 <= len(number) <= 15 if kind == "phone" else True


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return [(kind, a, z) for a, _, z, kind in sorted(found)]


def found(text):
    return [s[:3] for s in pii.Finder().spans(text)]


def own(text):
    return [s[:3] for s in pii.Finder().spans(text) if s[4]]


SIGNS = ["a@b.c", "@", ".", "a", "B-", "+", "%", "1.2.3.4", "255", "256.1.1.1", ".7", "0", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "12", " ", "-", "(", ")", "+1 (743) 555-3824", "\n", "é", "😀", "x.y@"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=25).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert own(text) == base_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.text("aA1.@-+ ()%9", max_size=60))
def test_base_spans_of_any_signs(text):
    assert own(text) == base_spans(text)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 AND MORE", ["iban"]),
        ("GB82WEST12345698765432.", ["iban"]),
        ("DE88370400440532013000", []),
        ("XDE89370400440532013000", []),
        ("DE893704004405320130001", []),
        ("my ssn is 123-45-6789", ["ssn"]),
        ("part 123-45-6789 in stock", []),
        ("ssn 666-45-6789, 000-12-1234, 923-45-6789, 123-00-6789, 123-45-0000", []),
        ("call (212) 555-0175 now", ["phone"]),
        ("model (212) 555-0175 now", []),
        ("DNI 12345678Z", ["dni"]),
        ("DNI 12345678A", []),
        ("nr 12345678Z", []),
        ("NIR 1 84 12 76 451 089 46", ["insurance"]),
        ("NIR 1 84 12 76 451 089 47", []),
        ("4111111111111111 4111111111111111", ["card", "card"]),
        ("4111111111111112 4111111111111111", ["card"]),
        ("7 4111 1111 1111 1111 9999", ["card"]),
        ("x4111111111111112", []),
        ("+49 (30) 1234567 tel 030 123", ["phone"]),
    ],
)
def test_added_kinds(text, kinds):
    assert [k for k, _, _ in found(text)] == kinds


def test_words_nearby_raise_the_score():
    near = pii.Finder().spans("my card: 4111111111111111")[0][3]
    far = pii.Finder().spans("my card" + " x" * 50 + " 4111111111111111")[0][3]
    assert far < near <= 1.0
    assert pii.Finder(least=0.8).spans("4111111111111111") == []


def test_an_added_span_inside_a_base_span_is_left_out():
    text = "call +1 212 555 0175 or write"
    assert found(text) == [("phone", 5, 20)]


def test_better_of_overlapping_added_spans():
    a, b, c = ("iban", 0, 22, 0.8, False), ("card", 5, 22, 0.6, False), ("dni", 30, 39, 0.7, False)
    assert pii.apart([b, a, c]) == [a, c]
    assert pii.apart([]) == []


def test_masks():
    text = "mail a@b.org, 4111111111111111 4111111111111111 end"
    spans = pii.Finder().spans(text)
    assert pii.masked(text, spans) == "mail <EMAIL>, <CARD> <CARD> end"
    assert pii.masked("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a<IP>f"


@pytest.mark.parametrize("text", ["1" * 300_000, "a." * 150_000, "1 " * 150_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "@a.b" * 70_000, "A" * 300_000, "x+-%._" * 50_000 + "@", "AD12" * 70_000])
def test_long_runs_take_linear_time(text):
    began = time.perf_counter()
    pii.Finder().spans(text)
    assert time.perf_counter() - began < 5


def texts():
    draw = random.Random(7)
    pieces = SIGNS + ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "123-45-6789", " ssn ", " call ", "(212) 555-0175", " DNI ", "12345678Z", " NIR ", "184127645108946", " card ", "4111111111111111 4111111111111111", " Konto ", "word ", "ñ"]
    return [None, "", "plain words only"] + ["".join(draw.choices(pieces, k=draw.randint(1, 30))) for _ in range(400)]


def test_query_on_odd_texts_equals_sql_and_patterns(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a@b.org"), (3000, "call a@b.org " + "word " * 40_000 + "+1 (743) 555-3824")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = sorted(map(tuple, queries.op12_pii_spans(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/*.parquet'")
    names = "doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans"
    assert got == sorted(con.sql(f"select {names} from ({queries.ORACLE['op12_pii_spans']})").fetchall(), key=str)
    by = dict(rows)
    for doc_id, *counts, digest, _ in got:
        want = base_spans(by[doc_id])
        assert counts == [sum(k == kind for k, _, _ in want) for kind in BASE]
        assert digest == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()


def test_other_columns_pass_and_clashing_ones_are_replaced(spark):
    df = spark.createDataFrame([(1, "a@b.org", "own", "kept"), (2, None, "own", "kept"), (2, None, "own", "kept")], "doc_id long, text string, spans string, kind string")
    got = pii.find(df, mask="clean").orderBy("doc_id").collect()
    assert [r["kind"] for r in got] == ["kept"] * 3 and [r["clean"] for r in got] == ["<EMAIL>", None, None]
    assert [len(r["spans"]) for r in got] == [1, 0, 0]
    assert pii.find(df.limit(0)).count() == 0
    assert pii.find(df, mask="text").columns == ["doc_id", "kind", "spans", "text"]


def test_plan_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    plan = pii.find(df).select(F.sha2(pii.listed(F.col("spans")), 256))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
