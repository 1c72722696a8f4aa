"""What each operator does with repeated rows, empty tables, very long texts and clashing columns, as its docstring says."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, hnsw, langid, mixing, tokenfiles, toxicity, warc
from gridloom.llm.queries import TOKENIZER_DIR

VOCAB = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
ENGLISH, GERMAN = "the thing that they think with this " * 4, "schön über straße nicht und der weiß " * 4


@pytest.fixture(scope="module")
def filters(spark):
    rows = [(k, ENGLISH if k % 2 else GERMAN, "en" if k % 2 else "de") for k in range(20)]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def test_language_of_repeated_long_and_clashing_rows(spark, filters):
    rows = [(1, ENGLISH, "own", 7.0, "kept"), (1, ENGLISH, "own", 7.0, "kept"), (2, GERMAN * 4000, "own", 7.0, "kept"), (3, None, "own", 7.0, "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, lang string")
    got = langid.predict(df, filters).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["lang_pred"], r["lang"]) for r in got] == [(1, "en", "kept"), (1, "en", "kept"), (2, "de", "kept"), (3, "und", "kept")]
    assert got[0]["score"] == got[1]["score"] and got[3]["score"] == 0 and len(got[0]) == 5
    assert langid.predict(df.limit(0), filters).count() == 0
    assert langid.learn(df.limit(0).withColumn("lang", F.lit("x")), F.lit(True)).langs == []


def test_toxicity_of_long_and_clashing_rows(spark):
    rows = [(k, f"awful hateful scum number{k}" if k % 4 == 0 else f"kind words about gardens number{k}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, "awful hateful scum " * 30_000, 5.0, "kept"), (2, "gardens " * 60_000, 5.0, "kept"), (2, "gardens " * 60_000, 5.0, "kept")], "doc_id long, text string, score double, label string")
    got = toxicity.score(odd, model).orderBy("doc_id").collect()
    assert [r["label"] for r in got] == ["kept"] * 3 and got[0]["score"] > got[1]["score"] == got[2]["score"] and len(got[0]) == 4
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.learn(docs.limit(0), labels, F.lit(True))
    assert all(0 <= r["score"] < 1e-12 for r in toxicity.score(docs.limit(3), none).collect())


def test_archives_of_long_payloads_extra_columns_and_none(spark, tmp_path):
    rows = [(1, "u", "x" * 3_000_000, "extra", "d"), (2, "u", "x" * 3_000_000, "extra", "d"), (3, None, "small", "extra", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string, _digest string")
    warc.write(pages, f"{tmp_path}/a")
    got = {r["record_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, f"{tmp_path}/a").collect()}
    assert got == {1: ("response", None, 3_000_000), 2: ("revisit", 1, 3_000_000), 3: ("response", None, 5)}
    warc.write(pages.limit(0), f"{tmp_path}/b")
    assert warc.read(spark, f"{tmp_path}/b").count() == 0


def test_token_files_of_null_texts_repeated_ids_and_extra_columns(spark, tmp_path):
    rows = [(1, "one two three", 9), (1, "four", 9), (2, None, 9), (3, "", 9), (4, "word " * 50_000, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, part long").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    places = tokenfiles.write(docs, f"{tmp_path}/t", VOCAB, 50256)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in tokenfiles.located(places, tokenfiles.counts(spark, f"{tmp_path}/t", 50256)).collect())
    coded = {r["doc_id"]: r["n"] for r in bpe.encode(docs.filter("doc_id = 4"), VOCAB).select("doc_id", (F.octet_length("ids") / 4).cast("int").alias("n")).collect()}
    assert [d for d, _ in got] == [1, 1, 2, 3, 4] and dict(got)[2] == dict(got)[3] == 0 and dict(got)[4] == coded[4]


def test_vectors_beside_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", 5), (2, [1.0, 0.01], "b", 6), (3, [0.0, 1.0], "c", 7)], "vec_id long, embedding array<double>, component_id string, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.links(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}


def test_mixing_beside_extra_columns(spark):
    rows = [(k, f"s{k % 3}", 5, "own", 1.5) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, sidx string, target double")
    got = mixing.mix(df).collect()
    assert len(got) == 30 and all(0 <= r["taken"] <= 10 for r in got)


def test_encoding_of_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "same text", b"own"), (1, "same text", b"own"), (2, "w" * 200_000, None)], "doc_id long, text string, ids binary")
    got = bpe.decode(bpe.encode(df, VOCAB), VOCAB).orderBy("doc_id").collect()
    assert got[0]["ids"] == got[1]["ids"] and [r["decoded"] for r in got] == ["same text", "same text", "w" * 200_000]
    assert bpe.encode(df.limit(0), VOCAB).count() == 0
