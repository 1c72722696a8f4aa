"""Fits from sums against the same chain fitted in numpy on the rows at hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import models
from gridloom.operators import fits, workflows
from gridloom.operators import learning as L


class Chain:
    """Preparation, selection, rotation and model with one set of parameters, fitted on training rows in one place."""

    def __init__(self, x, y, params, prep=None):
        self.prep = prep or models.Preparation(x)
        z = self.prep(x)
        order = models.top_features(models.logistic_l1(z, y, params["c"], 20_000)[:-1], z.shape[1])
        self.chosen = order[: params["k"]]
        self.rotation = models.Principal(z[:, self.chosen], params["pca"])
        name, strength = params["model"]
        u = self.rotation(z[:, self.chosen])
        self.w = models.logistic_l2(u, y, strength) if name == "lr" else models.discriminant(u, y, strength)

    def __call__(self, x):
        u = self.rotation(self.prep(x)[:, self.chosen])
        return models.sigmoid(u @ self.w[:-1] + self.w[-1])


def data(n=260, d=9, seed=4):
    """Features with missing values, one nearly constant and one double of another."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.4 + r.normal(size=(n, d))
    y = (x[:, 0] - x[:, 3] + r.normal(size=n) > 0.3).astype(int)
    x[:, 5] = np.where(np.arange(n) % 40 == 0, r.normal(size=n), 2.0)
    missing = r.random((n, d)) < 0.04
    missing[:, 1] = False
    x = np.where(missing, np.nan, np.round(x, 3))
    x[:, 6] = 3 * x[:, 1] - 1
    return x, y


def table(spark, x, y):
    rows = [(k, [None if np.isnan(v) else float(v) for v in row], int(label)) for k, (row, label) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(5)


SETS = 3
PARAMS = [{"c": c, "k": k, "pca": pca, "model": model} for c in (0.1, 1.0) for k in (3, 6) for pca in (None, 0.9) for model in (("lr", 0.3), ("lr", 3.0), ("lda", None), ("lda", 0.5))]


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    x, y = data()
    train = F.filter(F.array(*map(F.lit, range(SETS))), lambda s: s != F.col("id") % SETS)
    rows = table(spark, x, y).select("id", F.col("x").alias("_x"), F.col("y").alias("_y"), train.alias("train"), F.array((F.col("id") % SETS).cast("int")).alias("test"))
    path = f"{tmp_path_factory.mktemp('fits')}/rows"
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    return x, y, rows, fits.fitted(rows, SETS, lambda s, n: PARAMS)


def test_preparations_are_those_of_the_rows(fitted):
    x, y, _, found = fitted
    for s in range(SETS):
        want, got = models.Preparation(x[np.arange(len(x)) % SETS != s]), found[s][0].prep
        assert np.allclose(got.median, want.median) and np.array_equal(got.kept, want.kept)
        assert np.allclose(got.mean, want.mean) and np.allclose(got.std, want.std)
        assert 5 not in got.kept and not {1, 6} <= set(got.kept)


def test_middles_are_exact_and_count_no_values(spark, tmp_path, monkeypatch):
    """Even and odd numbers of rows, ties, both zeros, missing values, a feature without any, and signs."""
    r = np.random.default_rng(12)
    x = np.stack([r.normal(size=41), r.integers(-1, 2, 41) * 1.0, np.where(r.random(41) < 0.3, np.nan, r.normal(size=41) * 1e-300), np.full(41, np.nan), np.where(np.arange(41) % 9, -0.0, 0.0), np.round(r.normal(size=41), 1) * 1e9], axis=1)
    sets = [[k for k in range(3) if k != i % 3] for i in range(41)]
    spark.createDataFrame([([float(v) for v in row], s) for row, s in zip(x, sets, strict=True)], "_x array<double>, train array<int>").repartition(4).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(fits, "value_counts", None)
    medians, shares = fits.middles(rows, 3)
    for s in range(3):
        own = x[[s in held for held in sets]]
        want = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in own.T])
        assert np.array_equal(medians[s], want)
        assert np.allclose(shares[s], [(np.isnan(c) | (c == m)).mean() for c, m in zip(own.T, want, strict=True)])
    labelled = rows.withColumn("_y", (F.col("_x")[0] > 0).cast("int"))
    assert set(fits.prepared(labelled, 3)[0]) == {0, 1, 2}


def test_candidates_score_as_fits_on_the_rows(fitted):
    x, y, rows, found = fitted
    got = {(r["set"], r["position"], r["id"]): r["score"] for r in fits.scored(rows, found, "id", "test").collect()}
    assert len(got) == len(x) * len(PARAMS)
    for s in range(SETS):
        held = np.arange(len(x)) % SETS == s
        for at, params in enumerate(PARAMS):
            chain = Chain(x[~held], y[~held], params)
            assert set(found[s][at].rotation.chosen) == set(chain.chosen)
            want = chain(x[held])
            assert np.allclose([got[s, at, int(k)] for k in np.flatnonzero(held)], want, atol=2e-5), (s, params)


def test_first_fits_are_sparse_and_optimal(spark, fitted):
    x, y, rows, _ = fitted
    preps, _ = fits.prepared(rows, SETS)
    whole = {s: {("all", None): fits.Rotation(np.arange(len(p.kept)), None, np.zeros((2, len(p.kept))), np.zeros((len(p.kept),) * 2))} for s, p in preps.items()}
    problems = [fits.Problem(s, ("all", None), c, True, np.zeros(len(p.kept) + 1)) for s, p in preps.items() for c in (0.05, 1.0)]
    fits.solve(rows, SETS, preps, whole, problems)
    for p in problems:
        own = np.arange(len(x)) % SETS != p.set
        assert np.allclose(p.w, models.logistic_l1(preps[p.set](x[own]), y[own], p.c, 50_000), atol=1e-5)
    assert (problems[0].w[:-1] == 0).any()


def test_problems_are_cut_into_passes(fitted, monkeypatch):
    x, y, rows, found = fitted
    monkeypatch.setattr(fits, "PASS_BYTES", 300)
    few = fits.fitted(rows, SETS, lambda s, n: PARAMS[:2])
    for s in range(SETS):
        assert np.allclose(few[s][1].line, found[s][1].line, atol=1e-6)


def test_sums_are_added_in_two_levels(fitted, monkeypatch):
    x, y, rows, found = fitted
    monkeypatch.setattr(fits, "FAN", 2)
    again = fits.fitted(rows, SETS, lambda s, n: PARAMS[2:4])
    for s in range(SETS):
        for k in range(2):
            assert np.allclose(again[s][k].line, found[s][2 + k].line, atol=1e-6)


def test_partial_sums_alone_leave_tasks(fitted):
    """What a task sends doesn't grow with its rows."""
    _, _, rows, _ = fitted
    made = fits.summed(rows.unionByName(rows).unionByName(rows), lambda pdf: iter([(0, np.array([float(len(pdf))]))]), lambda k, total: (k, total), "problem int, sums array<double>")
    assert made.collect()[0]["sums"] == [3.0 * rows.count()]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInPandas") < plan.index("Exchange") < plan.index("MapInPandas")


def test_stored_models_score_as_the_chain(spark):
    x, y = data(seed=9)
    params = [PARAMS[1], PARAMS[5], PARAMS[6]]
    models_ = workflows.fit_all(table(spark, x, y), workflows.candidates_of(spark, params), "x", "y")
    got = {(r["candidate"], r["id"]): r["score"] for r in workflows.apply_models(models_, table(spark, x, y), "id", "x").collect()}
    for k, p in enumerate(params):
        assert np.allclose([got[k, i] for i in range(len(x))], Chain(x, y, p)(x), atol=2e-5)


def test_sets_with_one_class_are_out(spark, tmp_path):
    x, y = data(60)
    y[::2] = 0
    parts = spark.createDataFrame([(k, [float(v) for v in np.nan_to_num(row)], int(label), [0] if k % 2 else [0, 1]) for k, (row, label) in enumerate(zip(x, y, strict=True))], "id long, _x array<double>, _y int, train array<int>")
    parts.write.parquet(f"{tmp_path}/rows")
    found = fits.fitted(spark.read.parquet(f"{tmp_path}/rows"), 2, lambda s, n: PARAMS[:1])
    assert set(found) == {0}
    with pytest.raises(ValueError, match="both classes"):
        workflows.fit_all(parts.filter("_y = 0").select("id", F.col("_x").alias("x"), F.col("_y").alias("y")), workflows.candidates_of(spark, PARAMS[:1]), "x", "y")


def test_inner_search_gives_each_folds_areas(spark):
    x, y = data(seed=5)
    grid = {"c": (0.5,), "k": (4,), "pca": (None,), "model": (("lr", 1.0), ("lda", 0.2))}
    splits = [(k, o, (k // 3) % 2) for k in range(len(x)) for o in (0, 1) if k % 2 != o]
    made = L.inner_search(table(spark, x, y), spark.createDataFrame(splits, "id long, outer_fold int, inner_fold int"), "id", "x", "y", grid).collect()
    assert len(made) == 2 * 2 * 2
    for r in made:
        held = np.array([k for k, o, i in splits if o == r["outer_fold"] and i == r["inner_fold"]])
        train = np.array([k for k, o, i in splits if o == r["outer_fold"] and i != r["inner_fold"]])
        score = Chain(x[train], y[train], L.from_text(r["params"]))(x[held])
        assert r["auc"] == pytest.approx(models.auc(y[held], score), abs=2e-3) and r["ap"] == pytest.approx(models.average_precision(y[held], score), abs=5e-3)


@pytest.mark.parametrize("shrink", [None, 0.0, 0.3])
def test_discriminants_of_a_table(spark, shrink):
    x, y = data(seed=6)
    x = np.nan_to_num(x)
    assert np.allclose(fits.whole_discriminant(table(spark, x, y), "x", "y", shrink), models.discriminant(x, y, shrink))
    with pytest.raises(ValueError, match="both classes"):
        fits.whole_discriminant(table(spark, x[:9], np.zeros(9, int)), "x", "y")


def test_stages_of_a_pipeline_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from gridloom.operators import estimators

    x, y = data(seed=12)
    df = table(spark, x, y)
    prep = models.Preparation(x)
    last = {"lda": estimators.Discriminant(labelCol="y", shrinkage=0.2), "auto": estimators.Discriminant(labelCol="y"), "lr": estimators.RidgeLogistic(labelCol="y", c=0.5, outputCol="p")}
    want = {"lda": models.discriminant(prep(x), y, 0.2), "auto": models.discriminant(prep(x), y), "lr": models.logistic_l2(prep(x), y, 0.5)}
    for name, stage in last.items():
        pipeline = Pipeline(stages=[estimators.Preparer(inputCol="x"), stage])
        pipeline.save(f"{tmp_path}/{name}-pipeline")
        Pipeline.load(f"{tmp_path}/{name}-pipeline").fit(df).save(f"{tmp_path}/{name}")
        out = "p" if name == "lr" else "score"
        got = {r["id"]: r[out] for r in PipelineModel.load(f"{tmp_path}/{name}").transform(df).collect()}
        w = want[name]
        assert np.allclose([got[k] for k in range(len(x))], models.sigmoid(prep(x) @ w[:-1] + w[-1]), atol=1e-4), name
    with pytest.raises(ValueError, match="needs rows"):
        estimators.Preparer(inputCol="x").fit(df.limit(0))


def test_scores_are_shuffled_as_arrays(fitted, monkeypatch):
    """A row a batch and candidate, not one a row and candidate; sets of many rows are ranked in ranges, with the same areas."""
    x, y, rows, found = fitted
    made = fits.areas(rows, found, "id", "test")
    got = {(r["set"], r["position"]): (r["auc"], r["ap"]) for r in made.collect()}
    scores = fits.scored(rows, found, "id", "test").toPandas()
    for at, g in scores.groupby(["set", "position"]):
        s, label = g["score"].to_numpy(), g["y"].to_numpy()
        assert got[at] == pytest.approx((models.auc(label, s), models.average_precision(label, s)))
    assert len(got) == SETS * len(PARAMS)
    monkeypatch.setattr(fits, "RANKED", 86)
    again = {(r["set"], r["position"]): (r["auc"], r["ap"]) for r in fits.areas(rows, found, "id", "test").collect()}
    assert set(again) == set(got) and all(again[k] == pytest.approx(got[k]) for k in got)
