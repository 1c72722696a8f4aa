import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import models
from gridloom.operators import cases, learning, workflows
from gridloom.plans import learning as plans
from gridloom.plans.catalogue import QUERIES
from gridloom.plans.registry import Tables
from test_fits import Chain

FOLDER = "/root/testdata/sf0.001"


def features(spark, n=160, d=6):
    r = np.random.default_rng(8)
    x = r.normal(size=(n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=n) > 0).astype(int)
    x[::17, 2] = np.nan
    return x, y, spark.createDataFrame([(k, [float(v) for v in a], int(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "case_id long, x array<double>, y int")


PARAMS = [{"c": 0.5, "k": 4, "pca": None, "model": ("lr", 1.0)}, {"c": 0.5, "k": 4, "pca": 0.9, "model": ("lda", 0.2)}]


def test_stored_models_score_as_the_chain_does(spark):
    x, y, table = features(spark)
    models = workflows.fit_all(table, workflows.candidates_of(spark, PARAMS), "x", "y")
    got = workflows.apply_models(models, table, "case_id", "x").toPandas()
    for k, p in enumerate(PARAMS):
        want = Chain(x, y, p)(x)
        assert np.allclose(got[got["candidate"] == k].sort_values("case_id")["score"], want)


def test_out_of_fold_scores_cover_every_row_once(spark):
    x, y, table = features(spark)
    folds = table.select("case_id", (F.col("case_id") % 4).cast("int").alias("fold"))
    oof = workflows.out_of_fold(table, folds, workflows.candidates_of(spark, PARAMS), "case_id", "x", "y").toPandas()
    assert len(oof) == 2 * len(y) and oof.groupby("candidate")["case_id"].nunique().eq(len(y)).all()
    part = oof[(oof["candidate"] == 0) & (oof["case_id"] % 4 == 1)].sort_values("case_id")
    test = np.arange(len(y)) % 4 == 1
    assert np.allclose(part["score"], Chain(x[~test], y[~test], PARAMS[0])(x[test]))


def test_selection_prefers_complete_candidates(spark):
    rows = [(0, f, 0, "a", 0.9 if f else None, 0.5) for f in range(2)] + [(0, f, 1, "b", 0.7, 0.5) for f in range(2)] + [(0, f, 2, "c", 0.7, 0.5) for f in range(2)]
    scores = spark.createDataFrame(rows, "outer_fold int, inner_fold int, position int, params string, auc double, ap double")
    assert learning.best_parameters(scores).first()["params"] == "b"


def test_small_mask_keeps_its_middle(spark):
    mask = spark.createDataFrame([(1, 5, 5)], "case int, y int, x int")
    got = cases.patch_centres(mask, 1, 2, 0.9).collect()
    assert [(r["y"], r["x"]) for r in got] == [(5, 5)] and got[0]["overlap"] == pytest.approx(1 / 9)


def test_bags_are_scored_by_the_mean_of_inner_members(spark):
    r = np.random.default_rng(3)
    y, x = np.arange(24) % 2, r.normal(size=(24, 5, 3))
    x[:, 0, 0] += 3 * y
    rows = [(k, [float(v) for v in one], int(y[k]), k % 3) for k in range(24) for one in x[k]]
    got = learning.train_bags(spark.createDataFrame(rows, "bag long, x array<double>, y int, fold int"), "bag", "x", "y", "fold", hidden=4, epochs=12, patience=3).toPandas().sort_values("bag")
    assert list(got["bag"]) == list(range(24))
    known, want = np.flatnonzero(np.arange(24) % 3 != 1), []
    part = learning.inner_parts(y[known], 4, 43)
    for k in range(4):
        own, held = known[part != k], known[part == k]
        mean, std = np.concatenate(x[own]).mean(axis=0), np.concatenate(x[own]).std(axis=0)
        net = models.MaxPool(3, 4, 4200 + k).fit(list((x[own] - mean) / std), y[own], (list((x[held] - mean) / std), y[held]), 12, patience=3, seed=4200 + k)
        want.append([net.score((b - mean) / std) for b in x[1::3]])
    assert np.allclose(got["score"][got["fold"] == 1], np.mean(want, axis=0))


def test_more_vectors_make_more_bags(spark, tmp_path, monkeypatch):
    """25 bags of any number of vectors all hold the wanted digit, which leaves nothing to learn."""
    spark.range(2000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.sin(F.col("id") * k)).cast("array<float>").alias("embedding"), (F.xxhash64("id") % 5 + 5).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    train = learning.train_bags
    monkeypatch.setattr(learning, "train_bags", lambda *a, **k: train(*a, **k, hidden=4, epochs=2))
    got = QUERIES["l19_bag_evaluation"](spark, str(tmp_path)).toPandas()
    assert sorted(got["bag"]) == list(range(100)) and set(got["y"]) == {0, 1}


def test_gradients_of_bags_are_summed():
    r = np.random.default_rng(8)
    net, bags, y, w = models.MaxPool(3, 5, 1), [r.normal(size=(n, 3)) for n in (4, 1, 6)], np.array([1, 0, 1]), np.array([0.7, 1.5, 0.7])
    got = net.gradients(np.concatenate(bags), np.array([0, 4, 5]), y, w)

    def loss():
        s = np.array([net.score(b) for b in bags])
        return -(w * np.where(y == 1, np.log(s), np.log(1 - s))).sum()

    for g, at in zip(got, [*net.w, *net.b], strict=True):
        for place in list(np.ndindex(at.shape))[:12]:
            old = at[place]
            at[place] = old + 1e-6
            high = loss()
            at[place] = old - 1e-6
            assert g[place] == pytest.approx((high - loss()) / 2e-6, abs=1e-5)
            at[place] = old
    assert net.scores(np.concatenate(bags), np.array([0, 4, 5]), 4) == pytest.approx([net.score(b) for b in bags])


def test_queries_search_the_whole_grid(spark):
    t = Tables(spark, FOLDER)
    assert len(plans.table(t).first()["x"]) == 64
    got = QUERIES["l07_inner_search"](spark, FOLDER).groupBy("outer_fold", "inner_fold").count().collect()
    assert len(got) == 16 and {r["count"] for r in got} == {448}


def test_a_memorising_model_gets_no_weight(spark):
    """Labels are noise: fitted scores look perfect on the rows they were fitted to, out-of-fold ones don't."""
    import numpy as np

    from gridloom.operators import learning, metrics, workflows

    r = np.random.default_rng(5)
    rows = [(k, [float(v) for v in r.normal(size=60)], k % 2) for k in range(80)]
    table = spark.createDataFrame(rows, "case_id long, x array<double>, y int")
    own = table.selectExpr("case_id", "cast((case_id div 2) % 4 as int) outer_fold")
    params = {"c": 100.0, "k": 60, "pca": None, "model": ("lr", 1e6)}
    bases = learning.base_scores(table, workflows.inner_folds(table, own, "case_id", "y", 4, 1), own, workflows.candidates_of(spark, [params]), "case_id", "x", "y").cache()
    assert bases.filter("not inner").count() == 80 and bases.filter("inner").groupBy("outer_fold", "case_id").count().filter("count > 1").isEmpty()
    assert bases.filter("inner").count() == 240
    seen = learning.outer_scores(table, own, own.select("outer_fold").distinct().selectExpr("outer_fold", f"'{learning.as_text(params)}' params"), "case_id", "x", "y").filter("inner")
    auc = lambda df: [row["auc"] for row in metrics.auc_ap(df, ["outer_fold"], "y", "score").collect()]
    assert min(auc(seen)) > 0.99 and max(auc(bases.filter("inner"))) < 0.8
    stacked = workflows.stacking(table, own, [params], "case_id", "x", "y")
    assert stacked["predictions"].count() == 80


def test_one_class_has_no_other_rate(spark):
    from gridloom.operators import metrics

    df = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 1, 0.2, 0), ("b", 0, 0.1, 0), ("b", 1, 0.7, 1)], "g string, y int, s double, p int")
    got = {r["g"]: r for r in metrics.binary_metrics(df, ["g"], "y", "s", "p").collect()}
    assert (got["a"]["balanced_acc"], got["a"]["sensitivity"], got["a"]["specificity"], got["a"]["auc"]) == (0.5, 0.5, None, None)
    assert got["b"]["balanced_acc"] == 1


def test_summaries_leave_infinities_out(spark):
    from gridloom.operators.summaries import score_summary

    df = spark.createDataFrame([("a", 0.2), ("a", float("inf")), ("a", float("nan")), ("a", None), ("a", 0.6), ("b", float("-inf"))], "g string, s double")
    got = {r["g"]: r for r in score_summary(df, "g", "s", 0.5).collect()}
    assert got["a"]["count"] == 2 and got["a"]["mean"] == pytest.approx(0.4) and got["a"]["top1pct_mean"] == 0.6 and got["a"]["count_ge_0_60"] == 1
    assert got["b"]["count"] is None and got["b"]["max"] is None and got["b"]["count_ge_0_50"] is None


def test_cooccurrence_features_of_a_small_image(spark):
    import math

    from gridloom.operators import grids

    df = spark.createDataFrame([("a", 0, 0, 0), ("a", 0, 1, 2)], "case string, y int, x int, q int")
    got = grids.glcm(df).first()
    assert got["homogeneity"] == pytest.approx(1 / 3) and got["entropy"] == pytest.approx(math.log(2)) and got["contrast"] == 4


def test_a_failed_publish_keeps_the_old_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.sources import tables

    path = f"file://{tmp_path}/t.parquet"
    tables.publish(spark.range(3), path)
    with pytest.raises(Exception, match="stop"):
        tables.publish(spark.range(5).select(F.raise_error(F.lit("stop")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    tables.publish(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_candidates_that_miss_keys_are_named(spark):
    scores = [("full", k, 0.5) for k in range(12)] + [("short", k, 0.5) for k in range(3)] + [("short", k, 0.5) for k in (10, 11)] + [("holes", k, None if k == 11 else 0.1) for k in range(12)]
    df = spark.createDataFrame(scores, "candidate string, k int, score double")
    train, held = spark.range(10).selectExpr("cast(id as int) k"), spark.range(10, 12).selectExpr("cast(id as int) k")
    got = {r["candidate"]: (r["coverage"], r["missing_train"], r["missing_held"], list(r["examples"]), r["kept"]) for r in workflows.candidate_status(df, train, held, "k", 0.5).collect()}
    assert got == {"full": (1.0, 0, 0, [], True), "short": (pytest.approx(0.3), 7, 0, [3, 4, 5, 6, 7, 8, 9], False), "holes": (1.0, 0, 1, [11], False)}
    assert workflows.candidate_status(df, train.limit(0), held, "k", 0.5).filter("kept").count() == 0
