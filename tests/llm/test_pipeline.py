from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import neardup, queries

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = queries.table(spark, FOLDER, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near copies", "mixing", "encoding"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = queries.scratch(spark, "stage")
        stage(spark, kept[-1], FOLDER).write.parquet(path)
        kept.append(spark.read.parquet(path))
        assert kept[-1].columns == docs.columns and kept[-1].join(docs, "doc_id", "left_anti").isEmpty()
    toxic = {r["doc_id"] for r in queries.table(spark, FOLDER, "labels").filter("toxic = 1").collect()}
    left = {r["doc_id"] for r in kept[1].collect()}
    assert len(toxic & left) <= len(toxic) / 2
    assert kept[2].count() == kept[1].count()
    again = neardup.cluster(kept[3], width=5).filter("not kept")
    assert again.isEmpty() and kept[3].count() < kept[2].count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], FOLDER)
    assert last.count() == kept[-1].count() and last.filter("not round_trip").isEmpty()


def test_odd_rows(spark):
    rows = [(1, "abc def ghi jkl mno", None, None, 1), (1, "abc def ghi jkl mno", None, None, 1), (None, "abc def ghi jkl mno", "en", "s", 2), (2, None, "en", None, None), (3, "", "en", "s", 0), (4, "abc def ghi jkl mno", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("_lang", F.lit("x")).withColumn("_toxicity", F.lit(0.9)).withColumn("_copies", F.lit(0)).withColumn("_key", F.lit("k")).withColumn("_known", F.lit(1))
    languages = corpus_pipeline.in_known_language(spark, docs, FOLDER)
    assert {r["doc_id"] for r in languages.collect()} == {1, None, 4}
    copies = corpus_pipeline.without_near_copies(spark, docs, FOLDER)
    assert copies.columns == docs.columns and sorted(str(r["doc_id"]) for r in copies.collect()) == ["1", "2", "3", "None"]
    assert {r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, FOLDER).collect()} <= {1, None, 4, 2, 3}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns or name == "encoding"
    coded = {(r["doc_id"], r["n_tokens"]) for r in got.collect()}
    assert {(2, 0), (3, 0)} <= coded and got.filter("not round_trip").isEmpty()


def test_an_id_with_several_texts_and_very_long_texts(spark):
    long = " ".join(f"w{k % 7919}{k % 31}" for k in range(200_000))
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text of its own"), (3, long), (4, long + " end"), (5, None), (5, None), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    got = sorted((r["doc_id"], (r["text"] or "")[:5]) for r in corpus_pipeline.without_near_copies(spark, docs, FOLDER).collect())
    assert got == [(1, "a b c"), (2, "quite"), (3, long[:5]), (5, ""), (5, "x")]
    assert corpus_pipeline.without_toxic(spark, docs, FOLDER).filter("doc_id = 3").count() == 1
    assert corpus_pipeline.encoded(spark, docs, FOLDER).filter("not round_trip").isEmpty()


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 0 and got.filter("n_tokens <> octet_length(ids) / 4 or not round_trip").isEmpty()
