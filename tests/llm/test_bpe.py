import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import bpe, queries, tokenfiles

PATH = f"{queries.TOKENIZER_DIR}/byte_bpe_50k.json"
CODEC, LIBRARY = bpe.ByteBPE(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
END = "<|endoftext|>"
ids = lambda text: LIBRARY.encode(text, add_special_tokens=False).ids
unpack = lambda b: np.frombuffer(b, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'sé1a²\x1c\x85 　"))))
def test_encodes_and_decodes_as_the_library(text):
    got = unpack(CODEC.encode(text))
    assert got == ids(text)
    assert CODEC.decode(got) == LIBRARY.decode(got, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", END, f"a  {END}{END} b", "x" * 5000, "é" * 3000 + END + "ab" * 2000, "don't we'LL 'S 12½ ١٢"])
def test_edges(text):
    assert unpack(CODEC.encode(text)) == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text("thereion aslyñé", min_size=1, max_size=200))
def test_long_words_merge_in_the_same_order(word):
    assert CODEC.merge_short(word.encode()) == CODEC.merge_long(word.encode())


def test_table(spark):
    texts = ["Hello world", None, "", END + " tail", "y" * 100_000]
    df = spark.createDataFrame([(k, t, f"old{k}") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    for r in back.collect():
        assert unpack(r["ids"]) == ids(texts[r["doc_id"]] or "") and r["decoded"] == (texts[r["doc_id"]] or "")
    assert bpe.encode(df.limit(0), PATH).count() == 0
    invalid = spark.createDataFrame([(bytearray(np.array([50256, 60000, 128], "<u4").tobytes()),), (None,)], "ids binary")
    assert [r["decoded"] for r in bpe.decode(invalid, PATH).collect()] == [LIBRARY.decode([50256, 128], skip_special_tokens=False), None]


def test_query(spark):
    want = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = queries.op9_bpe_rank_array(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want)
    for r in got:
        known = ids(want[r["doc_id"]])
        assert r["n_tokens"] == len(known) and r["ids_sha256"] == hashlib.sha256(np.array(known, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(known, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(spark, tmp_path):
    for name, tokens, rest in (("a", [1, 2, 9, 9, 5, 9, 7, 8, 4, 4, 4, 9, 3], b"z"), ("b", [], b""), ("c", [9], b""), ("d", [4] * 10, b"")):
        (tmp_path / name).write_bytes(np.array(tokens, "<u2").tobytes() + rest)
    got = {}
    for r in tokenfiles.counts(spark, f"file://{tmp_path}", 9, block=3).orderBy("file", "ordinal").collect():
        got.setdefault(r["file"][-1], []).append(r["n_tokens"])
    assert got == {"a": [2, 0, 1, 5, 1], "c": [0], "d": [10]}


def test_counted_documents(spark):
    rows = [(0, "one two"), (1, None), (2, ""), (3, END), (4, "one two"), (5, "z" * 20_000)]
    path = queries.scratch(spark, "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs, out = spark.read.parquet(path), queries.scratch(spark, "tokens")
    places = tokenfiles.write(docs, out, PATH, 50256)
    got = {r["doc_id"]: r["n_tokens"] for r in tokenfiles.located(places, tokenfiles.counts(spark, out, 50256)).collect()}
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    assert got == {k: len(plain.encode(t or "", add_special_tokens=False).ids) for k, t in rows}


def test_counts_of_the_whole_table(spark):
    counted = queries.op5_token_separator_scan(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")["n_tokens"]
    encoded = queries.op9_bpe_rank_array(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")["n_tokens"]
    assert counted.sort_index().equals(encoded.sort_index())
