import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import clean, models, stats
from gridloom.operators import ordered, ranking


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_keys_and_labels(spark):
    raw = [(" a ",), ("",), ("NaN",), ("None",), ("<NA>",), ("na",), (None,), ("Nancy",)]
    assert values(spark, raw, "k string", clean.key(F.col("k"))) == ["a", None, None, None, None, None, None, "Nancy"]
    assert values(spark, [("TRUE",), ("y",), ("0",), ("f ",), ("2",), (None,)], "k string", clean.flag(F.col("k"))) == [1, 1, 0, 0, None, None]
    assert values(spark, [(" pz",), ("1",), ("x",), (None,)], "k string", clean.zone(F.col("k"))) == ["PZ", "TZ", None, None]
    rows = [(0, None), (1, "PZ"), (1, None), (None, "TZ")]
    assert values(spark, rows, "y int, z string", clean.three_class(F.col("y"), F.col("z"))) == ["FALSE", "TRUE_PZ", None, None]


def test_numbers(spark):
    assert values(spark, [("1.5",), ("x",), (None,)], "k string", clean.number(F.col("k"))) == [1.5, None, None]
    assert values(spark, [(1.0,), (math.inf,), (-math.inf,), (math.nan,), (None,)], "k double", clean.finite(F.col("k"))) == [1.0, None, None, None, None]


def test_thresholds_include_their_value(spark):
    rows = [(0.45, "zone"), (0.4499, "zone"), (0.5, "cs"), (0.4999, "cs")]
    assert values(spark, rows, "s double, t string", clean.predicted(F.col("s"), F.col("t"))) == [1, 0, 1, 0]


def test_families_take_the_first_rule(spark):
    names = [("best_cluster_heatmap",), ("smoothed_heatmap_max",), ("heatmap",), ("cs_x_pz",), ("frac_ge_0_5",), ("n_patches",), ("age",)]
    assert values(spark, names, "n string", clean.family(F.col("n"))) == ["cluster", "smooth heat", "heatmap", "cs-zone cross", "threshold", "patch count", "other"]


def test_parameter_texts(spark):
    df = spark.createDataFrame([({"b": "1", "a": "2"}, 0.95), ({}, None), (None, float("nan"))], "m map<string,string>, p double")
    assert [r[0] for r in df.select(clean.sorted_json(F.col("m"))).collect()] == ['{"a":"2","b":"1"}', "{}", "{}"]
    assert [r[0] for r in df.select(clean.share_key(F.col("p"))).collect()] == ["0.95", "off", "off"]


def test_moments_of_flat_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None), ("b", float("nan")), ("c", 1.0), ("c", 3.0)], "g string, v double")
    got = {r["g"]: r.asDict() for r in df.groupBy("g").agg(*stats.moments15(F.col("v"))).collect()}
    assert got["a"]["skew"] == 0 and got["a"]["kurt"] == 0 and got["a"]["std"] == 0
    assert all(got["b"][k] is None for k in ("mean", "std", "p90", "energy"))
    assert got["c"]["mean"] == 2 and got["c"]["var"] == 1 and got["c"]["kurt"] == pytest.approx(1)


def test_icc(spark):
    same = [(float(i), float(i)) for i in range(5)]
    assert values(spark, same, "a double, b double", stats.icc2_1(F.col("a"), F.col("b")))[0] == pytest.approx(1)
    assert values(spark, same[:2], "a double, b double", stats.icc2_1(F.col("a"), F.col("b")))[0] is None
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 2)) + r.normal(size=(40, 1)) * 2
    n, k = x.shape
    grand = x.mean()
    rows, cols = k * ((x.mean(1) - grand) ** 2).sum() / (n - 1), n * ((x.mean(0) - grand) ** 2).sum() / (k - 1)
    rest = ((x - x.mean(1, keepdims=True) - x.mean(0) + grand) ** 2).sum() / ((n - 1) * (k - 1))
    want = (rows - rest) / (rows + (k - 1) * rest + k * (cols - rest) / n)
    assert values(spark, [tuple(map(float, p)) for p in x], "a double, b double", stats.icc2_1(F.col("a"), F.col("b")))[0] == pytest.approx(want)


def test_rank01_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, None)], "i int, v double").withColumn("g", F.lit(0))
    got = [r[0] for r in ordered.rank01(df, "v", ["g"], "r").orderBy("i").select("r").collect()]
    assert got == [0.25, 0.25, 1.0, 0.5]


def test_ecdf_of_a_constant_reference(spark):
    ref = spark.createDataFrame([(0, 1.0)] * 3, "g int, v double")
    new = spark.createDataFrame([(0, 5.0), (0, 0.0)], "g int, v double")
    assert {r["u"] for r in ordered.ecdf(ref, new, ["g"], "v", "u").collect()} == {0.5}


def test_best_window_and_padding(spark):
    df = spark.createDataFrame([(0, z, a, 1) for z, a in enumerate([1, 5, 5, 1])], "c int, z int, a int, near int")
    assert ranking.best_window(df, "c", "z", "a", 2, "near").first()["start"] == 1
    assert ranking.padded_positions(2, 0, 5) == [0, 0, 0, 1, 1]
    assert ranking.padded_positions(2, 1, 5) == [0, 0, 1, 1, 1]


def test_diverse_choice_under_caps(spark):
    rows = [("g", i, 10 - i, "a" if i < 4 else "b", "m" if i % 2 else "n") for i in range(8)]
    df = spark.createDataFrame(rows, "g string, i int, s int, f string, m string")
    one = ranking.diverse_top(df, ["g"], ["s", "i"], [False, True], 4, {"f": 1}).orderBy("candidate_rank")
    assert [r["i"] for r in one.collect()] == [0, 4, 1, 2]
    two = ranking.diverse_top(df, ["g"], ["s", "i"], [False, True], 3, {"f": 2, "m": 1}).orderBy("candidate_rank")
    assert [r["i"] for r in two.collect()] == [0, 1, 2]


def test_linear_models_meet_their_objectives():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 4))
    y = (x[:, 0] - x[:, 1] + r.normal(size=200) > 0).astype(int)
    w = models.logistic_l2(x, y, 0.7)
    p = models.sigmoid(x @ w[:-1] + w[-1])
    assert np.abs(x.T @ (0.7 * models.balanced_weights(y) * (p - y)) + w[:-1]).max() < 1e-6
    v = models.logistic_l1(x, y, 0.05, 5000)
    slope = x.T @ (0.05 * models.balanced_weights(y) * (models.sigmoid(x @ v[:-1] + v[-1]) - y))
    on = v[:-1] != 0
    assert np.abs(slope[on] + np.sign(v[:-1][on])).max() < 1e-3 and (np.abs(slope[~on]) <= 1 + 1e-3).all()
    d = models.discriminant(x, y)
    assert models.auc(y, x @ d[:-1] + d[-1]) > 0.8


def test_metrics_under_ties():
    y, s = np.array([0, 1, 1, 0]), np.array([0.1, 0.1, 0.9, 0.2])
    assert models.auc(y, s) == 0.625
    assert models.auc(y, -s) == pytest.approx(1 - 0.625)
    assert math.isnan(models.auc(np.ones(3), np.arange(3.0)))


def test_preparation_drops_later_twins_and_quasi_constants():
    r = np.random.default_rng(5)
    x = r.normal(size=(100, 3))
    x = np.column_stack([x, x[:, 0] * 2 + 1, np.ones(100), np.where(np.arange(100) < 96, 0, 1)])
    x[3, 1] = np.nan
    prep = models.Preparation(x)
    assert prep.kept.tolist() == [0, 1, 2]
    z = prep(x)
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0), 1)


def test_max_pool_learns_a_marked_instance():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(6, 3)) for _ in range(60)]
    y = np.arange(60) % 2
    for b, t in zip(bags, y, strict=True):
        b[2, 0] += 6 * t
    net = models.MaxPool(3, 8, 1).fit(bags[:40], y[:40], (bags[40:50], y[40:50]), epochs=60, rate=1e-2)
    assert models.auc(y[50:], np.array([net.score(b) for b in bags[50:]])) > 0.9
    eps, k = 1e-6, (0, 1, 2)
    probe = models.MaxPool(3, 8, 2)
    g = probe.gradients(bags[1], 1, 1.0)[0]
    loss = lambda: -math.log(probe.score(bags[1]))
    before = loss()
    probe.w[0][k[1], k[2]] += eps
    assert (loss() - before) / eps == pytest.approx(g[k[1], k[2]], abs=1e-4)


def test_names_for_display(spark):
    raw = [("s1_csPCa_likelihood_smoothed_heatmap_count_ge_threshold",), ("s4_PZ_heatmap_top10_mean",), ("a_largest_hotspot_mm3",), ("x" * 60,), (None,)]
    assert values(spark, raw, "n string", clean.short_name(F.col("n"))) == ["S1 csPCa smooth count ge thr", "s4 PZ heat top10 mean", "a hotspot mm3", "x" * 53 + ".", None]
    ids = [("fs||k=5||feature--book.xlsx||lr",), ("feature--book.xlsx",), ("a||b",)]
    assert values(spark, ids, "i string", clean.file_of(F.col("i"))) == ["book", "book", "a||b"]


def test_an_unknown_spread_costs_the_largest(spark):
    rows = [("g", "a", 0.8, None), ("g", "b", 0.8, 0.1), ("g", "c", None, 0.0), ("h", "d", 0.5, None)]
    df = spark.createDataFrame(rows, "g string, c string, m double, s double")
    got = {r["c"]: r["p"] for r in ranking.penalised(df.withColumn("s", F.when(F.col("c") == "c", 0.3).otherwise(F.col("s"))), ["g"], "m", "s", 0.5, "p").collect()}
    assert got == {"a": pytest.approx(0.65), "b": pytest.approx(0.75), "c": -math.inf, "d": 0.5}


def test_bags_are_scaled_one_by_one(monkeypatch):
    r = np.random.default_rng(4)
    rows = r.normal(3, 2, size=(50, 4)).astype(np.float32)
    rows[:, 3] = 7
    begins, ends = np.array([0, 9, 20, 21, 40]), np.array([9, 20, 21, 40, 50])
    some = models.Bags(rows, begins, ends).of(np.array([0, 2, 4]))
    own = np.concatenate([rows[0:9], rows[20:21], rows[40:50]]).astype(float)
    scaled = some.scaled()
    assert scaled.rows is rows and np.allclose(scaled.mean, own.mean(axis=0)) and np.allclose(scaled.std, np.append(own.std(axis=0)[:3], 1))
    pieces = list(scaled.pieces(10))
    assert [len(x) for x, _ in pieces] == [10, 10] and [f.tolist() for _, f in pieces] == [[0, 9], [0]]
    assert np.allclose(np.concatenate([x for x, _ in pieces]), np.concatenate(list(scaled))) and np.allclose(np.concatenate(list(scaled)).mean(axis=0), 0)
