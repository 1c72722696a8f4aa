import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import grids, learning, metrics, ranges, relational, sampling
from gridloom.sources import tables, volumes
from gridloom.streaming import resume


def test_checks_name_examples(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(relational.Violation, match=r"\(1,\)"):
        relational.require_unique(df, ["k"])
    with pytest.raises(relational.Violation, match=r"\(2,\)"):
        relational.require_coverage(df, df.filter("k = 1"), ["k"])
    with pytest.raises(relational.Violation):
        relational.one_to_one(df.filter("v = 'a'"), df.filter("v = 'c'"), ["k"])


def test_left_side_keeps_its_columns(spark):
    a = spark.createDataFrame([(1, "left")], "k int, v string")
    b = spark.createDataFrame([(1, "right", 5)], "k int, v string, w int")
    assert relational.left_wins(a, b, ["k"]).collect() == [(1, "left", 5)]
    assert relational.upsert(a, b.drop("w"), ["k"]).collect() == [(1, "right")]


def test_empty_columns_go(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "k int, a string, b double")
    assert relational.without_empty_columns(df, ["k"]).columns == ["k", "b"]


def test_range_join_equals_brute_force(spark):
    r = np.random.default_rng(4)
    c = [(int(k), int(i), int(v)) for i, (k, v) in enumerate(zip(r.integers(0, 3, 40), r.integers(-50, 50, 40), strict=True))]
    p = [(int(k), int(i), int(v)) for i, (k, v) in enumerate(zip(r.integers(0, 3, 200), r.integers(-60, 60, 200), strict=True))]
    got = ranges.containing(spark.createDataFrame(c, "k int, c int, m int"), spark.createDataFrame(p, "k int, p int, a int"), ["k"], "m", "a", 7)
    want = {(ci, pi) for k, ci, m in c for q, pi, a in p if k == q and abs(a - m) <= 7}
    assert sorted((x["c"], x["p"]) for x in got.collect()) == sorted(want)


def test_folds_cover_and_are_disjoint(spark):
    df = spark.range(101).select("id", (F.col("id") % 3).alias("s"))
    nested = sampling.nested_folds(df, "id", ["s"], 4, 4, 7).toPandas()
    for fold, part in nested.groupby("outer_fold"):
        assert part["id"].is_unique and set(part["inner_fold"]) == {0, 1, 2, 3}
        assert abs(len(part) - 101 * 3 / 4) < 4
    own = nested.groupby("id")["outer_fold"].nunique()
    assert (own == 3).all()


def test_ranks_in_pieces_equal_one_window(spark):
    keyed = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("s"), F.lit("kept").alias("_piece")).unionByName(spark.range(3).select(F.lit(1).cast("long").alias("id"), F.lit(1).cast("long").alias("s"), F.lit("kept").alias("_piece")))
    order = [sampling.draw(3, "id"), F.col("id")]
    made = sampling.placed(keyed, ["s"], order, "n")
    once = keyed.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy(*order)))
    assert made.columns == once.columns and sorted(made.collect(), key=str) == sorted(once.collect(), key=str)
    assert sampling.placed(keyed.limit(0), ["s"], order, "n").count() == 0
    assert sorted(r["n"] for r in sampling.placed(keyed, [], order, "n").collect()) == list(range(1, 504))


def test_balanced_sample_keeps_all_of_the_smallest_class(spark):
    df = spark.range(100).select("id", (F.col("id") < 10).cast("int").alias("y"))
    got = sampling.balanced(df, "y", 1000, 2.0, [sampling.draw(1, "id")]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {1: 10, 0: 20}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=4, max_size=30))
def test_auc_is_mirrored_by_negated_scores(spark, rows):
    df = spark.createDataFrame([(0, y, float(s)) for y, s in rows], "g int, y int, s double")
    a = metrics.auc_ap(df, ["g"], "y", "s").first()["auc"]
    b = metrics.auc_ap(df.withColumn("s", -F.col("s")), ["g"], "y", "s").first()["auc"]
    assert (a is None and b is None) or a + b == pytest.approx(1)


def test_confusion_has_every_pair(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 1, 0)], "g string, y int, p int")
    got = {(r["y"], r["p"]): (r["n"], r["share"]) for r in metrics.confusion(df, ["g"], "y", "p", [0, 1]).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (0, 0), (1, 0): (1, 0.5), (1, 1): (1, 0.5)}


def image(spark, a):
    return spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(np.asarray(a))], "case int, y int, x int, v double")


def test_flat_grid_cooccurrence(spark):
    r = grids.glcm(grids.quantised(image(spark, np.full((3, 3), 7)), 16)).first()
    assert (r["contrast"], r["asm"], r["entropy"], r["homogeneity"], r["correlation"]) == (0, 1, 0, 1, 0)


def test_components_by_corner_and_by_face(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 3, 3)], "case int, y int, x int")
    assert grids.components(cells).select("label").distinct().count() == 2
    assert grids.components(cells, full=False).select("label").distinct().count() == 3


def test_euler_number_of_a_ring(spark):
    ring = [(1, y, x) for y in range(1, 4) for x in range(1, 4) if (y, x) != (2, 2)]
    assert grids.euler(spark.createDataFrame(ring, "case int, y int, x int")).first()["euler"] == 0


def test_filters_equal_direct_sums(spark):
    a = np.random.default_rng(0).normal(size=(6, 7))
    got = {(r["y"], r["x"]): r["v"] for r in grids.laws(image(spark, a), "E5L5", ("y", "x")).collect()}
    padded = np.pad(a, 2, mode="symmetric")
    # The first kernel runs along y, and convolution turns both round.
    kernel = np.outer(grids.LAWS["E5"][::-1], grids.LAWS["L5"][::-1])
    for (y, x), v in got.items():
        assert v == pytest.approx((padded[y : y + 5, x : x + 5] * kernel).sum())
    g = grids.gradient(image(spark, a)).collect()
    dy, dx = np.gradient(a)
    assert all(r["dy"] == pytest.approx(dy[r["y"], r["x"]]) and r["dx"] == pytest.approx(dx[r["y"], r["x"]]) for r in g)


def test_heatmap_is_zero_where_nothing_covers(spark):
    patches = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, float("nan"))], "case int, y int, x int, score double")
    got = {(r["y"], r["x"]): r["heat"] for r in grids.average_heatmap(patches, image(spark, np.zeros((4, 4))), 1).collect()}
    assert got[0, 0] == 0.5 and got[3, 3] == 0 and got[1, 3] == 0


def test_cell_lengths():
    assert [grids.odd_cells(m, s) for m, s in ((9, 3), (8, 2), (5, 2), (1, 9))] == [3, 5, 3, 1]


def test_volume_files(spark):
    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    for packed in (True, False):
        got, spacing = volumes.decode(volumes.encode(x, (3.0, 0.5, 0.25), packed))
        assert (got == x).all() and spacing == (3.0, 0.5, 0.25)
    files = spark.createDataFrame([("a", bytearray(volumes.encode(x, (3, 1, 1)))), ("b", bytearray(b"junk\n"))], "case_id string, content binary")
    slices = volumes.scan(files)
    assert slices.count() == 2 and volumes.voxels(slices).agg(F.sum("v")).first()[0] == x.sum()
    finer = volumes.voxels(volumes.resampled(slices, (3.0, 0.5, 0.5)))
    assert finer.filter("z = 0 and y = 1 and x = 1").first()["v"] == pytest.approx((0 + 1 + 4 + 5) / 4)
    assert volumes.same_shape(slices, slices.withColumn("h", F.lit(9))).count() == 0


def test_streams_that_do_not_align(spark):
    a, b = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k int, a double"), spark.createDataFrame([(1, 0.5), (3, 0.5)], "k int, b double")
    with pytest.raises(ValueError, match="align"):
        volumes.detections([a, b], ["k"], ["a", "b"])


def test_tables(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    spark.createDataFrame([("007", "1.5", "x"), ("8", "2", "3")], "id string, n string, m string").write.option("header", True).csv(path)
    df = tables.scan(spark, path, "id")
    assert dict(df.dtypes) == {"id": "string", "n": "double", "m": "string"} and df.filter("id = '007'").count() == 1
    assert tables.scan_or_empty(spark, f"{tmp_path}/none", df.schema).count() == 0
    dup = spark.createDataFrame([(" a", 1), ("a ", 2)], "case_id string, v int")
    tables.publish(dup, f"{tmp_path}/d.parquet")
    with pytest.raises(relational.Violation):
        tables.features(spark, f"{tmp_path}/d.parquet")


def test_resume(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") * 2).alias("v"))
    for part in (rows.filter("id < 4"), rows, rows):
        resume.append_missing(part, f"{tmp_path}/sink", "id")
    assert resume.published(spark, f"{tmp_path}/sink", rows.schema).count() == 10
    state: dict[str, int] = {}
    stage = lambda n, needs=(): resume.Stage(n, lambda: state.update({n: state.get(n, 0) + 1}), lambda: n in state, needs)
    run = resume.Run([stage("a"), stage("b", ["a"]), stage("c")])
    assert run(["b"]) == [("a", "run"), ("b", "run")]
    assert resume.Run(run.stages)(["b", "c"]) == [("a", "skipped"), ("b", "skipped"), ("c", "run")]


def test_moments_and_correlations(spark):
    x = np.random.default_rng(3).normal(1e3, 2.0, (200, 3)) @ np.array([[1, 0, 2], [0, 1, 0], [0, 0, 1e-3]])
    rows = spark.createDataFrame([(v,) for v in np.column_stack([x, np.full(200, 7.0)]).tolist()], "x array<double>").repartition(5)
    n, mean, cov = learning.moments(rows, "x")
    assert n == 200 and np.allclose(mean[:3], x.mean(axis=0)) and mean[3] == 7
    assert np.allclose(cov[:3, :3], np.cov(x.T, bias=True), atol=1e-6)
    found = learning.correlations(np.pad(np.cov(x.T, bias=True), (0, 1)))
    assert np.allclose(found[:3, :3], np.corrcoef(x.T)) and not found[3].any()
    assert learning.moments(rows.limit(0), "x")[0] == 0


def test_prepared_drops_what_an_earlier_column_tells(spark):
    rows = [(k, float(v), float(2 * v + 1), None if k % 5 == 0 else float(k % 3), 4.0) for k, v in enumerate(np.random.default_rng(5).normal(0, 1, 60))]
    made, kept = learning.prepared(spark.createDataFrame(rows, "id int, a double, b double, c double, d double"), ["a", "b", "c", "d"])
    assert kept == ["a", "c"] and made.columns == ["id", "a", "c"]
