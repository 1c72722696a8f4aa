"""The two jobs: runs over growing input, reruns, failures between writes, odd rows and command lines."""

import datetime as dt
import json
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import common, feature_book, queries, score_ledger

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"


def ordered(df):
    names = sorted(df.columns)
    return sorted((tuple(None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


SCORES = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
FIRST = [
    (1, at(1), 7, "a", 1.0, "x"), (2, at(1, 3), 7, "a", 3.0, None), (3, at(1, 4), 7, "a", 5.0, ""), (4, at(1, 5), 7, "a", 7.0, ""), (5, at(1, 6), 7, "a", math.inf, ""),
    (6, at(2), 8, None, math.nan, ""), (7, at(2), 8, None, None, ""), (8, None, 8, "a", 1.0, ""), (None, at(2), None, "a", 1.0, ""), (9, at(3), 9, "b", 2.5, ""), (9, at(3), 9, "b", 2.0, ""),
]
SECOND = [
    (1, at(1), 7, "a", 99.0, "again"), (10, at(1, 9), 7, "a", 9.0, "late"), (11, at(4), 7, "b", 4.0, ""), (12, at(4), 7, "b", 4.0, ""), (13, at(4), None, "b", 4.0, ""), (6, at(5), 8, None, 6.0, "other day"),
]


def put(spark, rows, folder, name):
    """One more file in a folder that is read as it grows."""
    spark.createDataFrame(rows, SCORES).coalesce(1).write.parquet(f"{folder}/{name}")


def source(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/in/*", f"{tmp_path}/out"


def ledger(spark, scores, out):
    return {(str(r["day"]), r["case_id"], r["channel"]): r for r in score_ledger.read(spark, scores, out)["ledger"].collect()}


def test_ledger_takes_what_is_new(spark, tmp_path):
    folder, scores, out = source(tmp_path)
    put(spark, FIRST, folder, "one")
    (first,) = score_ledger.run(spark, scores, out)
    assert (first["taken"], first["rejected"], first["days"]) == (9, 2, 3)
    got = ledger(spark, scores, out)
    one = got["2024-01-01", 7, "a"]
    assert (one["taken"], one["scored"], one["mean"], one["least"], one["most"], one["best_mean"]) == (5, 4, 4.0, 1.0, 7.0, 5.0)
    assert one["std"] == pytest.approx(math.sqrt(5), abs=1e-6)
    none = got["2024-01-02", 8, None]
    assert (none["taken"], none["scored"], none["mean"], none["best_mean"]) == (2, 0, None, None)
    assert got["2024-01-03", 9, "b"]["mean"] == 2.0, "of equal ids the smallest score of a batch stays"
    assert {r["reasons"] for r in score_ledger.read(spark, scores, out)["rejected"].collect()} == {"no ts", "no score_id, no case_id"}

    assert score_ledger.run(spark, scores, out) == [], "nothing is new"
    assert ledger(spark, scores, out) == got

    put(spark, SECOND, folder, "two")
    (second,) = score_ledger.run(spark, scores, out)
    assert (second["taken"], second["rejected"], second["days"]) == (5, 1, 3)
    then = ledger(spark, scores, out)
    late = then["2024-01-01", 7, "a"]
    assert (late["taken"], late["scored"], late["mean"], late["best_mean"]) == (6, 5, 5.0, 7.0), "the late score counts, the repeated id doesn't"
    assert then["2024-01-04", 7, "b"]["taken"] == 2 and then["2024-01-05", 8, None]["mean"] == 6.0
    assert {k: v for k, v in then.items() if k[0] in ("2024-01-02", "2024-01-03")} == {k: v for k, v in got.items() if k[0] in ("2024-01-02", "2024-01-03")}


def test_days_without_news_are_not_written_again(spark, tmp_path):
    folder, scores, out = source(tmp_path)
    put(spark, FIRST, folder, "one")
    score_ledger.run(spark, scores, out)
    files = lambda: {str(p) for p in Path(out, "ledger").rglob("*.parquet")}
    before = files()
    put(spark, SECOND, folder, "two")
    score_ledger.run(spark, scores, out)
    kept = {p for p in before & files()}
    assert {Path(p).parent.name for p in kept} == {"day=2024-01-02", "day=2024-01-03"}


def test_growing_and_whole_input_agree(spark, tmp_path):
    """Copies of the given table in five files, taken one a run, against one run over all."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    folder, scores, out = source(tmp_path)
    for k in range(5):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k).coalesce(1).write.parquet(f"{folder}/part{k}")
        assert sum(d["taken"] for d in score_ledger.run(spark, scores, out)) == spark.read.parquet(f"{folder}/part{k}").count()
    whole = f"{tmp_path}/whole"
    score_ledger.run(spark, scores, whole)
    assert ordered(score_ledger.read(spark, scores, out)["ledger"]) == ordered(score_ledger.read(spark, scores, whole)["ledger"])


@pytest.mark.parametrize("stop_at", ["detail", "ledger"])
def test_a_run_that_stopped_is_mended(spark, tmp_path, monkeypatch, stop_at):
    folder, scores, out = source(tmp_path)
    put(spark, FIRST, folder, "one")
    score_ledger.run(spark, scores, out)
    put(spark, SECOND, folder, "two")
    write = score_ledger.write

    def stops(df, path, *partitions):
        if path.endswith(stop_at):
            raise OSError("stopped")
        write(df, path, *partitions)

    monkeypatch.setattr(score_ledger, "write", stops)
    with pytest.raises(Exception, match="stopped"):
        score_ledger.run(spark, scores, out)
    monkeypatch.undo()
    assert [d["batch"] for d in score_ledger.run(spark, scores, out)] == [1]
    whole = f"{tmp_path}/straight"
    for name in ("one", "two"):
        score_ledger.run(spark, f"{folder}/{{{','.join(['one', 'two'][: 1 + (name == 'two')])}}}", whole)
    assert ordered(score_ledger.read(spark, scores, out)["ledger"]) == ordered(score_ledger.read(spark, scores, whole)["ledger"])
    assert score_ledger.read(spark, scores, out)["detail"].count() == len(FIRST) + len(SECOND) - 3


def test_several_batches_a_run(spark, tmp_path):
    folder, scores, out = source(tmp_path)
    put(spark, FIRST, folder, "one")
    put(spark, SECOND, folder, "two")
    done = score_ledger.run(spark, scores, out, common.config("score_ledger") | {"files_a_batch": 1})
    assert [d["batch"] for d in done] == [0, 1] and sum(d["taken"] + d["rejected"] for d in done) == len(FIRST) + len(SECOND)


def test_ledger_of_an_empty_table(spark, tmp_path):
    folder, scores, out = source(tmp_path)
    put(spark, [], folder, "none")
    score_ledger.run(spark, scores, out)
    assert all(df.count() == 0 for df in score_ledger.read(spark, scores, out).values())


def test_ledger_of_the_given_table_equals_sql(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    got = queries.job2_score_ledger(spark, FOLDER)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{FOLDER}/events.parquet'")
    want = con.sql(f"select {', '.join(sorted(got.columns))} from ({queries.ORACLE['job2_score_ledger']})").fetchall()
    assert ordered(got) == sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in want), key=str)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


DOCS = [
    ("1", "One two two.\nThree!"), ("2", ""), ("3", None), (" 4 ", "ÀB c 12"), ("nan", "no id"), (None, "no id"), ("5", "plain words here"), ("5", "plain words here, longer"), ("6", "x " * 30_000),
    *((str(k), f"case {k} " + "word " * (k % 7) + "." * (k % 3)) for k in range(10, 40)),
]
LABELS = [("1", "TRUE"), ("2", "no"), ("3", "y"), ("4", "0"), ("4", "1"), ("5", "maybe"), ("99", "1"), (None, "1"), *((str(k), str(k % 2)) for k in range(10, 40))]


@pytest.fixture
def cohort(spark, tmp_path):
    spark.createDataFrame([(a, b, "kept", k) for k, (a, b) in enumerate(DOCS)], "doc_id string, text string, label string, fold int").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(LABELS, "doc_id string, quality string").write.parquet(f"{tmp_path}/labels")
    return f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out"


def test_book_is_scaled_by_training_rows(spark, cohort):
    counts = feature_book.run(spark, *cohort)
    cases = feature_book.read(spark, cohort[2], "cases").toPandas().set_index("case_id")
    book = feature_book.read(spark, cohort[2], "book").toPandas()
    assert counts == {"documents": len(DOCS), "labels": len(LABELS), "cases": 36, "leaks": 0, "scales": 4 * len(feature_book.FEATURES), "book": 4 * 36}
    assert len(cases) == 36 and cases.index.is_unique and len(book) == 4 * 36
    assert cases.loc["4", "label"] == 1 and np.isnan(cases.loc["5", "label"]) and cases.loc["5", "fold"] == -1
    assert cases.loc["1", "log_words"] == pytest.approx(math.log(5)) and cases.loc["1", "distinct_words"] == pytest.approx(1.0)
    assert cases.loc["4", "bytes_per_char"] == pytest.approx(8 / 7) and cases.loc["4", "digits"] == pytest.approx(2 / 7)
    assert np.isnan(cases.loc["3", "log_chars"]) and cases.loc["2", "log_chars"] == 0 and np.isnan(cases.loc["2", "digits"])
    assert cases.loc["6", "log_words"] == pytest.approx(math.log(30_001))
    for fold, rows in book.groupby("outer_fold"):
        rows = rows.set_index("case_id")
        train = cases[(cases["fold"] >= 0) & (cases["fold"] != fold)]
        assert set(rows.index[rows["role"] == "test"]) == set(cases.index[cases["fold"] == fold])
        assert set(rows.index[rows["role"] == "train"]) == set(train.index)
        for f in feature_book.FEATURES:
            std = train[f].std(ddof=0)
            want = ((cases[f] - train[f].mean()) / std).fillna(0) if std > 0 else cases[f] * 0
            assert np.allclose(rows.loc[cases.index, f], want.fillna(0), atol=2e-6), f


def test_scales_tell_what_training_rows_say(spark, cohort):
    feature_book.run(spark, *cohort)
    cases = feature_book.read(spark, cohort[2], "cases").toPandas()
    for r in feature_book.read(spark, cohort[2], "scales").collect():
        train = cases[(cases["fold"] >= 0) & (cases["fold"] != r["outer_fold"])]
        x = train[r["feature"]]
        assert r["n"] == x.count() and r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(ddof=0), abs=1e-12)
        one, zero = (x[train["label"] == k] for k in (1, 0))
        spread = math.sqrt((one.var() + zero.var()) / 2)
        assert r["difference"] == (pytest.approx((one.mean() - zero.mean()) / spread, abs=1e-9) if spread > 0 else None)


def test_ids_that_differ_in_marks_alone_are_counted(spark, tmp_path):
    ids = [f"Case-{k}" for k in range(20)] + [f"case {k}" for k in range(20)]
    spark.createDataFrame([(i, "a b c") for i in ids], "doc_id string, text string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(i, "1") for i in ids], "doc_id string, quality string").write.parquet(f"{tmp_path}/labels")
    counts = feature_book.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out")
    fold = {r["case_id"]: r["fold"] for r in feature_book.read(spark, f"{tmp_path}/out", "cases").collect()}
    assert counts["leaks"] == sum(fold[f"Case-{k}"] != fold[f"case {k}"] for k in range(20)) > 0


def test_folds_deal_each_class_evenly(spark, cohort):
    feature_book.run(spark, *cohort)
    per = feature_book.read(spark, cohort[2], "cases").filter("label is not null").groupBy("label", "fold").count().toPandas()
    for _, rows in per.groupby("label"):
        assert set(rows["fold"]) == {0, 1, 2, 3} and rows["count"].max() - rows["count"].min() <= 1


def test_book_reruns_and_follows_its_input(spark, cohort):
    feature_book.run(spark, *cohort)
    first = [ordered(feature_book.read(spark, cohort[2], n)) for n in ("cases", "scales", "book")]
    feature_book.run(spark, *cohort)
    assert [ordered(feature_book.read(spark, cohort[2], n)) for n in ("cases", "scales", "book")] == first
    spark.createDataFrame([("50", "one more", "kept", 0)], "doc_id string, text string, label string, fold int").write.mode("append").parquet(cohort[0])
    assert feature_book.run(spark, *cohort)["cases"] == 37
    two = common.config("feature_book") | {"folds": 2}
    feature_book.run(spark, *cohort, two)
    assert {r[0] for r in feature_book.read(spark, cohort[2], "book").select("outer_fold").distinct().collect()} == {0, 1}, "no fold of an earlier run is left"


def test_book_without_labels_or_rows(spark, tmp_path):
    texts = spark.createDataFrame([("1", "a b")], "doc_id string, text string")
    marks = spark.createDataFrame([], "doc_id string, quality string")
    settings = common.config("feature_book")
    rows = feature_book.cases(texts, marks, settings)
    made = feature_book.book(rows, feature_book.scales(rows, settings), settings).collect()
    assert len(made) == 4 and {r["role"] for r in made} == {"apply"} and all(r["log_chars"] == 0.0 for r in made)
    texts.limit(0).write.parquet(f"{tmp_path}/documents")
    marks.write.parquet(f"{tmp_path}/labels")
    assert feature_book.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out")["book"] == 0


def test_texts_are_read_once_and_not_shuffled(spark, cohort):
    made = feature_book.cases(spark.read.parquet(cohort[0]), spark.read.parquet(cohort[1]), common.config("feature_book"))
    lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
    (scan,) = [k for k, line in enumerate(lines) if "FileScan" in line and ",text:string" in line]
    above = lines[:scan]
    assert max(k for k, line in enumerate(above) if "LOG1P" in line) > max(k for k, line in enumerate(above) if "Exchange" in line)


def test_config_files(tmp_path):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"folds": 7}))
    assert common.config("feature_book", str(own))["folds"] == 7
    own.write_text(json.dumps({"fold": 7}))
    with pytest.raises(ValueError, match="unknown settings"):
        common.config("feature_book", str(own))


@pytest.mark.parametrize("name", ["feature_book", "score_ledger"])
def test_command_lines(spark, cohort, tmp_path, name):
    """A process of its own, which makes and ends its own session."""
    put(spark, FIRST, f"{tmp_path}/in", "one")
    paths = {"feature_book": ["--documents", cohort[0], "--labels", cohort[1]], "score_ledger": ["--scores", f"{tmp_path}/in/*"]}[name]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{name}.py"), *paths, "--output", f"{tmp_path}/{name}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/{name}/{'book' if name == 'feature_book' else 'ledger'}").count() > 0


def test_jobs_leave_the_corpus_operators_alone():
    for path in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        text = path.read_text(encoding="utf-8")
        assert ".".join(["gridloom", "llm"]) not in text and "_".join(["corpus", "pipeline"]) not in text
