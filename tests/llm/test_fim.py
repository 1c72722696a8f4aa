import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import fim


def direct(doc_id, text):
    """The contract, read literally: (n, form, prefix, middle, output)."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


ODD = [None, "", "x", "\n", "ab", "a\r\nb", "é́", "😀👨‍👩‍👧", "<P>", "a<S>b", "<M", "<P<S<M", "><P", "\x00\x01", "ß" * 1023 + "😀" * 3, "z" * (2 * fim.PIECE + 9), " " * 50]


def test_every_row_follows_the_contract(spark):
    rows = [(k, ODD[k % len(ODD)]) for k in range(400)] + [(None, "no id"), (-7, "negative id"), (5, "again"), (5, "again"), (9, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.transform(df).withColumn("back", fim.restored())
    got = made.collect()
    assert len(got) == len(rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == direct(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=700), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_ranks_are_those_of_code_points(text, first, second):
    n = len(text)
    assert fim.Cutter().cut(text, first, second) == (n, *sorted((first % (n + 1), second % (n + 1))))


@pytest.mark.parametrize("n", [0, 1, fim.WIDTH - 1, fim.WIDTH, fim.WIDTH + 1, 5 * fim.WIDTH, fim.PIECE - 1, fim.PIECE, fim.PIECE + 1, 2 * fim.PIECE, 2 * fim.PIECE + 77])
def test_blocks_and_pieces_are_stitched(n):
    text = ("aé😀\n" * n)[:n]
    cutter = fim.Cutter()
    assert np.array_equal(cutter.offsets(text), np.arange(0, n, fim.WIDTH))
    for first, second in ((0, n), (n // 2, n // 3), (max(0, n - 1), 1)):
        assert cutter.cut(text, first, second) == (n, *sorted((first % (n + 1), second % (n + 1))))


def test_other_units_are_cut_between_matches():
    lines = fim.Cutter(r"[^\n]*\n")
    assert lines.offsets("ab\ncd\n\ne").tolist() == [0, 3, 6, 7]
    assert lines.cut("ab\ncd\n\ne", 6, 3) == (4, 3, 7)


def test_lines_as_units_keep_lines_whole(spark):
    text = "".join(f"line {k}\n" for k in range(40))
    df = spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string")
    got = fim.transform(df, unit=r"[^\n]*\n", plain_from=100).withColumn("back", fim.restored()).collect()
    for r in got:
        assert r["n"] == 40 and r["back"] == text
        assert all(p == "" or p.endswith("\n") for p in (text[: r["prefix_chars"]], text[: r["prefix_chars"] + r["middle_chars"]]))


def test_other_markers_and_shares(spark):
    own = fim.Markers("[pre]", "[suf]", "[mid]")
    df = spark.createDataFrame([(k, "a <P> b.*\\E") for k in range(50)], "doc_id long, text string")
    got = fim.transform(df, markers=own, plain_from=100, spm_below=100).withColumn("back", fim.restored(markers=own)).collect()
    assert {r["form"] for r in got} == {"spm"} and all(r["back"] == "a <P> b.*\\E" and r["output"].startswith("[suf]") for r in got)
    assert {r["form"] for r in fim.transform(df, plain_from=0).collect()} == {"plain"}


def test_other_columns_pass_and_clashing_ones_are_replaced(spark):
    df = spark.createDataFrame([(1, "some text", "own", 5, "x", "y")], "doc_id long, text string, form string, N int, _whole string, _low string")
    got = fim.transform(df)
    assert got.columns == ["doc_id", "text", "_whole", "_low", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = got.first()
    assert (row["_whole"], row["_low"], row["n"]) == ("x", "y", 9) and row["form"] in ("plain", "psm", "spm")
    assert fim.transform(df, out="text").columns == ["doc_id", "_whole", "_low", "n", "form", "prefix_chars", "middle_chars", "text"]


def test_empty_table_and_ids_of_text(spark):
    df = spark.createDataFrame([("a7", "some text")], "doc_id string, text string")
    assert fim.transform(df.limit(0)).count() == 0
    row = fim.transform(df).first()
    assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == direct("a7", "some text")


def test_plan_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    plan = fim.transform(df).withColumn("back", F.sha2(fim.restored(), 256))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("text", ["<", "<P", "<<P", "P>", "<S<S", "<M<P"])
def test_pieces_of_markers_at_the_cuts(spark, text):
    df = spark.createDataFrame([(k, text) for k in range(80)], "doc_id long, text string")
    assert {r["back"] for r in fim.transform(df).select(fim.restored().alias("back")).collect()} == {text}
