import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import textures as T
from gridloom.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_catalogue_has_its_410_maps():
    specs = T.catalogue()
    assert len(specs) == 410 and len({s["name"] for s in specs}) == 410


def test_laws_in_three_dimensions():
    """By the rule: the first kernel runs along z, and out[i] is the sum of kernel[j] * x[i - j]."""
    x = np.random.default_rng(0).normal(size=(5, 6, 7))
    p = np.pad(x, 2, mode="symmetric")
    k = np.einsum("i,j,k->ijk", T.LAWS["E5"], T.LAWS["L5"], T.LAWS["S5"])[::-1, ::-1, ::-1]
    got = T.laws(x, "E5L5S5")
    assert got[2, 3, 4] == pytest.approx((p[2:7, 3:8, 4:9] * k).sum()) and got[0, 0, 0] == pytest.approx((p[:5, :5, :5] * k).sum())
    ramp = np.broadcast_to(np.arange(9.0)[:, None, None], (9, 3, 3))
    # Along a rising z an edge kernel that ends in 1 is turned round, so its response is negative.
    assert T.laws(ramp, "E3L3L3")[4, 1, 1] == -2 * 16 and T.laws(ramp, "L3L3E3")[4, 1, 1] == 0


def test_a_case_without_mask_has_no_statistics(spark):
    from gridloom.operators.textures import texture_table

    row = [("a", 0, 2, 2, 1.0, 1.0, 1.0, [1.0, 2.0, 3.0, 4.0], [0.0] * 4)]
    df = spark.createDataFrame(row, "case_id string, z int, h int, w int, sz double, sy double, sx double, v array<double>, mask array<double>")
    values = [r["value"] for r in texture_table(df, T.catalogue()[:2]).collect()]
    assert values == [None] * 8


def test_filters_by_axes_are_those_by_transforms(monkeypatch):
    r = np.random.default_rng(4)
    x, spacing = r.normal(size=(3, 9, 11)), (3.0, 0.5, 0.7)
    for short in (64, 4):
        monkeypatch.setattr(T, "SHORT", short)
        held: dict = {}
        for spec in [s for s in T.catalogue() if s["family"] == "gabor"][::23]:
            kernel = T.gabor_kernel(spec["wavelength"], spec["azimuth"], spec["elevation"], spacing)
            assert np.allclose(T.gabor(x, spec, spacing, held), T.convolved(x, kernel))
        assert np.allclose(T.laws(x, "E5L5S5", held), T.along(T.along(T.along(x, T.LAWS["E5"][::-1], 0), T.LAWS["L5"][::-1], 1), T.LAWS["S5"][::-1], 2))


def test_cases_of_one_shape_share_their_kernels(monkeypatch):
    made, parts = [], T.gabor_parts
    monkeypatch.setattr(T, "gabor_parts", lambda *a: made.append(a) or parts(*a))
    T.gabor_steps.cache_clear()
    specs = [s for s in T.catalogue() if s["family"] == "gabor"]
    for k in range(3):
        for spec in specs:
            T.texture_map(np.random.default_rng(k).normal(size=(4, 8, 8)), np.ones((4, 8, 8), bool), spec, (3.0, 0.5, 0.5), {})
    assert len(made) == len(specs)


def test_statistics_of_many_maps_are_those_of_each():
    r = np.random.default_rng(6)
    maps = r.normal(size=(5, 31))
    maps[1], maps[2, 3], maps[3] = 2.0, np.nan, np.inf
    assert np.allclose(T.fours(maps), [T.four(m) for m in maps], equal_nan=True)
    assert np.isnan(T.fours(np.zeros((2, 0)))).all()


def test_local_statistics_at_masked_voxels(monkeypatch):
    r = np.random.default_rng(7)
    x, mask = r.normal(size=(3, 5, 6)), r.random((3, 5, 6)) > 0.5
    monkeypatch.setattr(T, "HELD", 300)
    for name, got in T.local(x, mask, 5).items():
        assert np.allclose(got, T.LOCAL[name](T.windows(x, 5))[mask])


def test_wide_rows_are_not_shuffled_after_their_tasks(spark):
    wide = QUERIES["g17_wide_features"](spark, FOLDER)
    assert len(wide.columns) == 1641
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "pivot" not in plan


def test_laws_of_cells_are_those_of_volumes(spark):
    from gridloom.operators import grids

    r = np.random.default_rng(5)
    shapes = {1: (1, 4, 5), 2: (4, 3, 6)}
    data = {c: r.normal(size=n) for c, n in shapes.items()}
    df = spark.createDataFrame([(c, *map(int, at), float(v)) for c, x in data.items() for at, v in np.ndenumerate(x) for at in [at]], "case long, z int, y int, x int, v double")
    for code in ("E5L5S5", "W5R5L5", "L3E3S3"):
        want = {c: T.laws(x, code) for c, x in data.items()}
        got = grids.laws(df, code).collect()
        assert len(got) == df.count() and all(r["v"] == pytest.approx(want[r["case"]][r["z"], r["y"], r["x"]]) for r in got)


def test_windows_are_mirrored():
    x = np.arange(6.0).reshape(2, 3)
    assert sorted(T.windows(x, 3)[0, 0]) == [0, 0, 0, 0, 1, 1, 3, 3, 4]
    assert T.LOCAL["range"](T.windows(x, 3))[1, 2] == 4


def test_gabor_kernels_and_convolution():
    k = T.gabor_kernel(3.261, 0.785, 2.356, (3.0, 0.5, 0.5))
    # Three deviations are 5.5 mm: two slices and eleven pixels to either side.
    assert k.shape == (5, 23, 23) and k.sum() == pytest.approx(0, abs=1e-9) and np.linalg.norm(k) == pytest.approx(1)
    assert T.gabor_kernel(0.88, 0, 0, (3.0, 0.5, 0.5)).shape == (3, 7, 7)
    k = T.gabor_kernel(2.075, 0.785, 0.785, (3.0, 2.0, 2.0))
    x = np.random.default_rng(1).normal(size=(6, 7, 8))
    r = [n // 2 for n in k.shape]
    p, flipped = np.pad(x, [(n, n) for n in r], mode="symmetric"), k[::-1, ::-1, ::-1]
    got = T.convolved(x, k)
    assert got.shape == x.shape and got[3, 0, 7] == pytest.approx((p[3 : 3 + k.shape[0], : k.shape[1], 7 : 7 + k.shape[2]] * flipped).sum())


def test_gradients_are_one_sided_at_ends_and_sobel_maps_are_filtered_again():
    x = np.random.default_rng(3).normal(size=(4, 5, 6))
    g = T.gradients(x)
    assert len(g) == 13 and np.allclose([g["dz"], g["dy"], g["dx"]], np.gradient(x))
    p = np.pad(g["sobel_x"], 1, mode="symmetric")
    k = np.einsum("i,j,k->ijk", (1, 2, 1), (-1, 0, 1), (1, 2, 1))
    assert g["sobel_xy"][2, 0, 5] == pytest.approx((p[2:5, 0:3, 5:8] * k).sum())
    assert not T.gradients(x[:1])["dz"].any()


def test_haralick_of_a_window():
    x = np.random.default_rng(2).integers(0, 8, (5, 5)).astype(float)
    x[0, 0], x[4, 4] = 0, 7
    q, counts = T.quantised(x, 8), np.zeros((8, 8))
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        for y in range(1, 4):
            for c in range(1, 4):
                counts[q[y, c], q[y - dy, c - dx]] += 1
    p = counts / counts.sum()
    want = dict(zip(T.HARALICK, T.haralick_maps(x, 3)[2, 2], strict=True))
    i, j = np.indices((8, 8))
    hx, both = (-(v[v > 0] * np.log(v[v > 0])).sum() for v in (p.sum(1), p))
    assert want["contrast"] == pytest.approx((p * (i - j) ** 2).sum()) and want["asm"] == pytest.approx((p * p).sum())
    assert want["difference_average"] == pytest.approx((p * abs(i - j)).sum()) and want["entropy"] == pytest.approx(both)
    hy = -(p.sum(0)[p.sum(0) > 0] * np.log(p.sum(0)[p.sum(0) > 0])).sum()
    outer = np.outer(p.sum(1), p.sum(0))
    cross = -(p[p > 0] * np.log(outer[p > 0])).sum()
    assert want["imc1"] == pytest.approx((both - cross) / max(hx, hy)) and want["imc2"] == pytest.approx(np.sqrt(1 - np.exp(-2 * (hx + hy - both))))
    flat = T.haralick_maps(np.full((4, 4), 3.0), 3)[1, 1]
    assert flat[0] == pytest.approx(1) and flat[1] == 0 and flat[4] == pytest.approx(1)
    mask = np.zeros((2, 5, 5), bool)
    mask[1, 2, 2] = True
    got = T.haralick_volume(np.stack([x, x]), mask, 3)
    assert not got[0].any() and np.allclose(got[1, 2, 2], T.haralick_maps(x[1:4, 1:4], 3)[1, 1])


def test_euler_numbers():
    assert T.euler(np.ones((3, 3, 3))) == 1
    ring = np.ones((1, 3, 3))
    ring[0, 1, 1] = 0
    shell = np.ones((3, 3, 3))
    shell[1, 1, 1] = 0
    corners = np.zeros((2, 2, 2))
    corners[0, 0, 0] = corners[1, 1, 1] = 1
    assert (T.euler(ring), T.euler(shell), T.euler(corners), T.euler(np.zeros((2, 2, 2)))) == (0, 2, 1, 0)


def test_surface_of_a_ball():
    n, r = 24, 9.0
    z, y, x = np.indices((n, n, n)) - (n - 1) / 2
    ball = (z * z + y * y + x * x) <= r * r
    smooth = 4 * np.pi * r * r
    assert smooth < T.surface(ball, (1, 1, 1)) < 1.35 * smooth
    assert 540 < T.surface(np.ones((10, 10, 10)), (1, 1, 1)) < 640
    assert T.surface(ball, (2, 2, 2)) == pytest.approx(4 * T.surface(ball, (1, 1, 1)))
    assert T.surface(np.zeros((3, 3, 3)), (1, 1, 1)) == 0


def test_four_moments():
    assert T.four(np.array([3.0, 3.0])) == (0.0, 3.0, 0.0, 0.0) and all(map(np.isnan, T.four(np.array([np.nan, np.inf]))))
    k, m, s, v = T.four(np.array([1.0, 3.0]))
    assert (k, m, s, v) == (1.0, 2.0, 0.0, 1.0)


@pytest.mark.parametrize("name, maps", [("g09_laws_volumes", 152), ("g12_gabor", 160), ("g13_haralick", 65)])
def test_queries_run_whole_families(spark, name, maps):
    n = QUERIES[name](spark, FOLDER).groupBy("case_id").agg(F.count_distinct("feature").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert tuple(n) == (4 * maps, 4 * maps)


def test_wide_features_keep_all_statistics(spark):
    names = [f"{s['name']}_{x}" for s in T.catalogue() for x in ("kurt", "median", "skew", "var")]
    assert QUERIES["g17_wide_features"](spark, FOLDER).columns == ["case_id", *names]
