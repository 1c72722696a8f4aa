"""Smoothing, morphology, continuity and clusters of volumes against direct loops over arrays."""

import math
from itertools import product

import numpy as np
import pytest

from gridloom.operators import clusters

SHAPES = {"a": (4, 7, 6), "b": (1, 5, 5), "c": (3, 4, 8), "flat": (2, 3, 3)}
SPACING = (3.0, 0.5, 0.5)


def volumes(seed=11):
    """By case (organ, value, zones): smooth noise with values that aren't finite; one case without hot cells, and one organ that ends at the border."""
    r, made = np.random.default_rng(seed), {}
    for case, shape in SHAPES.items():
        v = r.random(shape)
        for axis in range(1, 3):
            v = (v + np.roll(v, 1, axis)) / 2
        v = (v - v.min()) / (v.max() - v.min())
        organ = r.random(shape) < (0.9 if case != "c" else 1.0)
        if case == "flat":
            v = v * 0.4
        else:
            v[tuple(x // 2 for x in shape)] = np.nan
            v[0, 0, 0] = np.inf
        z = r.random(shape)
        made[case] = (organ, v, z, 1 - z)
    return made


def table(spark, made):
    rows = [(c, *map(int, at), bool(organ[at]), *(float(x[at]) for x in rest)) for c, (organ, *rest) in made.items() for at in np.ndindex(organ.shape)]
    return spark.createDataFrame(rows, "case string, z int, y int, x int, organ boolean, v double, pz double, tz double").repartition(3)


def arrays(df, column, made, dtype=float):
    got = {c: np.full(organ.shape, np.nan) for c, (organ, *_) in made.items()}
    for r in df.select("case", "z", "y", "x", column).collect():
        got[r["case"]][r["z"], r["y"], r["x"]] = float(r[column])
    return {c: a.astype(dtype) for c, a in got.items()}


def boxes(shape, at, reach):
    return list(product(*(range(max(0, i - r), min(n, i + r + 1)) for i, n, r in zip(at, shape, reach, strict=True))))


def grow(m, reach):
    return np.array([any(m[p] for p in boxes(m.shape, at, reach)) for at in np.ndindex(m.shape)]).reshape(m.shape)


def shrink(m, reach):
    full = math.prod(2 * r + 1 for r in reach)
    return np.array([sum(m[p] for p in boxes(m.shape, at, reach)) == full for at in np.ndindex(m.shape)]).reshape(m.shape)


def parts(m, full):
    """Components by flood, in order of their first cells."""
    label, n = np.zeros(m.shape, int), 0
    for at in np.ndindex(m.shape):
        if m[at] and not label[at]:
            n += 1
            stack = [at]
            while stack:
                p = stack.pop()
                if not label[p]:
                    label[p] = n
                    stack += [q for q in boxes(m.shape, p, (1,) * m.ndim) if m[q] and (full or sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1)]
    return label, n


def fill(m, organ):
    out = np.zeros_like(m)
    for z in range(len(m)):
        sl = m[z] & organ[z]
        label, n = parts(~sl, False)
        edge = set(label[0]) | set(label[-1]) | set(label[:, 0]) | set(label[:, -1])
        out[z] = (sl | np.isin(label, [k for k in range(1, n + 1) if k not in edge])) & organ[z]
    return out


def hot(v, organ, least):
    return np.isfinite(v) & (np.nan_to_num(v, posinf=0) >= least) & organ


@pytest.fixture(scope="module")
def made():
    return volumes()


def test_smoothing(spark, made):
    got = arrays(clusters.smoothed(table(spark, made), "v"), "smooth", made)
    kernel = {1: np.array(clusters.gaussian(0.5)), 2: np.array(clusters.gaussian(1.0))}
    assert len(kernel[1]) == 5 and len(kernel[2]) == 9
    for c, (organ, v, *_) in made.items():
        valid = np.isfinite(v) & organ
        num, den = np.where(valid, np.nan_to_num(v, posinf=0), 0), valid.astype(float)
        for axis, k in ((0, kernel[1]), (1, kernel[2]), (2, kernel[2])):
            r = len(k) // 2
            pad = lambda a: np.pad(a, [(r, r) if x == axis else (0, 0) for x in range(3)], mode="edge")  # noqa: B023, E731
            slide = lambda a: sum(w * np.take(pad(a), np.arange(j, j + a.shape[axis]), axis) for j, w in enumerate(k))  # noqa: B023, E731
            num, den = slide(num), slide(den)
        want = np.where(organ & (den > 1e-6), np.clip(num / np.maximum(den, 1e-300), 0, 1), 0)
        assert np.allclose(got[c], want)


@pytest.mark.parametrize(("axes", "radius"), [(clusters.AXES, 1), (("y", "x"), 1), (clusters.AXES, 2)])
def test_morphology(spark, made, axes, radius):
    reach = tuple(radius if a in axes else 0 for a in clusters.AXES)
    df = table(spark, made).withColumn("m", clusters.at_least("v", 0.55))
    grown, cut, shut = (arrays(f(df, "m", axes, radius), "m", made, bool) for f in (clusters.dilated, clusters.eroded, clusters.closed))
    for c, (organ, v, *_) in made.items():
        m = hot(v, organ, 0.55)
        assert np.array_equal(grown[c], grow(m, reach)) and np.array_equal(cut[c], shrink(m, reach))
        assert np.array_equal(shut[c], shrink(grow(m, reach), reach))
        border = [i == 0 or i == n - 1 for n, r in zip(m.shape, reach, strict=True) if r for i in (0,)]
        assert not border or not shut[c][tuple(0 if r else slice(None) for r in reach)].any(), "cells at the border go"


def test_layer_support_and_holes(spark, made):
    df = table(spark, made).withColumn("m", clusters.at_least("v", 0.5))
    support = arrays(clusters.layer_supported(df, "m", "s"), "s", made, bool)
    whole = clusters.filled(df, ["m"], labels=["m"])
    holes, numbers = arrays(whole, "m", made, bool), arrays(whole, "m_label", made, int)
    for c, (organ, v, *_) in made.items():
        m = hot(v, organ, 0.5)
        near = grow(m, (0, 1, 1))
        beside = np.zeros_like(m)
        beside[1:] |= near[:-1]
        beside[:-1] |= near[1:]
        assert np.array_equal(support[c], m & beside)
        assert np.array_equal(holes[c], fill(m, organ)) and np.array_equal(numbers[c], parts(fill(m, organ), True)[0])


def test_zone_continuity(spark, made):
    got = {r["case"]: r for r in clusters.zone_continuity(table(spark, made), "v", 0.5, SPACING).collect()}
    for c, (organ, v, *_) in made.items():
        m = hot(v, organ, 0.5)
        whole = fill(shrink(grow(m, (1, 1, 1)), (1, 1, 1)) & organ, organ)
        label, n = parts(whole, True)
        r = got[c]
        assert (r["raw_voxels"], r["smoothed_voxels"], r["filled_gap_voxels"]) == (m.sum(), whole.sum(), max(0, whole.sum() - m.sum()))
        assert r["smooth_density"] == pytest.approx(whole.sum() / max(1, organ.sum()))
        sizes = [int((label == k).sum()) for k in range(1, n + 1)]
        best = label == (sizes.index(max(sizes)) + 1) if n else np.zeros_like(m)
        x = v[best & np.isfinite(v)]
        want = (best.sum(), best.any(axis=(1, 2)).sum(), x.mean() if len(x) else 0, x.max() if len(x) else 0, np.percentile(x, 90) if len(x) else 0)
        assert (r["largest_voxels"], r["largest_layers"], r["largest_mean"], r["largest_max"], r["largest_p90"]) == pytest.approx(want)
        assert r["largest_mm3"] == pytest.approx(best.sum() * 0.75)
    assert got["flat"]["raw_voxels"] == 0


def ranked(organ, v, pz, tz, least):
    """The clusters' figures of a case, best first, with the masks that they come from."""
    m = hot(v, organ, least)
    near, beside = grow(m, (0, 1, 1)), np.zeros_like(m)
    beside[1:] |= near[:-1]
    beside[:-1] |= near[1:]
    core = m & beside
    whole = fill(shrink(grow(core, (0, 1, 1)), (0, 1, 1)) & organ, organ)
    label, n = parts(whole, True)
    rows = []
    for k in range(1, n + 1):
        own = label == k
        x, y = v[own & np.isfinite(v)], v[own & core & np.isfinite(v)]
        if len(x):
            y = y if len(y) else x
            layers = int(own.any(axis=(1, 2)).sum())
            top = np.sort(x)[-max(1, math.ceil(0.1 * len(x))) :].mean()
            parts_ = (y.mean(), np.percentile(y, 90), top, x.max(), min(1, math.log1p(own.sum()) / math.log1p(1000)), min(1, layers / 5), (own & core).sum() / own.sum())
            rows.append((float(np.dot((0.35, 0.25, 0.15, 0.10, 0.08, 0.04, 0.03), parts_)), own, layers, top))
    return m, core, whole, n, sorted(rows, key=lambda r: -r[0])


@pytest.mark.parametrize("least", [0.45, 0.6])
def test_dominant_clusters(spark, made, least):
    got = {r["case"]: r for r in clusters.dominant_clusters(table(spark, made), "v", "pz", "tz", least, SPACING).collect()}
    assert set(got) == set(made)
    for c, (organ, v, pz, tz) in made.items():
        m, core, whole, n, rows = ranked(organ, v, pz, tz, least)
        r = got[c]
        assert (r["raw_hot_voxels"], r["z_supported_hot_voxels"], r["xy_filled_cluster_voxels"], r["raw_num_clusters"]) == (m.sum(), core.sum(), whole.sum(), n)
        assert r["ignored_single_slice_clusters"] == int(m.any() and not whole.any())
        if not rows:
            assert r["dominant_zone_label_code"] == -1 and r["best_cluster_score"] == 0 and r["dominance_ratio"] == 0
            continue
        score, own, layers, top = rows[0]
        second = rows[1][0] if len(rows) > 1 else 0
        x = v[own & np.isfinite(v)]
        assert r["best_cluster_score"] == pytest.approx(score) and r["second_cluster_score"] == pytest.approx(second)
        assert r["dominance_ratio"] == pytest.approx(score / second if second else score)
        assert (r["best_cluster_voxels"], r["best_cluster_z_slices"], r["best_cluster_core_hot_voxels"]) == (own.sum(), layers, (own & core).sum())
        assert (r["best_cluster_mean"], r["best_cluster_top10_mean"], r["best_cluster_p90"]) == pytest.approx((x.mean(), top, np.percentile(x, 90)))
        assert r["top3_cluster_voxels_total"] == sum(int(k[1].sum()) for k in rows[:3]) and r["top2_cluster_score_mean"] == pytest.approx(np.mean([k[0] for k in rows[:2]]))
        finite = np.where(np.isfinite(v), v, 0)
        w = [(finite * zone)[own].sum() for zone in (pz, tz)]
        a, b = (k / sum(w) for k in w)
        assert (r["dominant_first_ratio"], r["dominant_second_ratio"]) == pytest.approx((a, b))
        assert r["dominant_zone_entropy"] == pytest.approx(-(a * math.log(a) + b * math.log(b)))
        assert r["dominant_zone_label_code"] == (0 if a >= 0.65 else 1 if b >= 0.65 else 0.5)
        zone = fill(shrink(grow(hot(pz, organ, 0.5), (1, 1, 1)), (1, 1, 1)) & organ, organ)
        assert r["dominant_first_mask_fraction"] == pytest.approx((own & zone).sum() / own.sum())


def test_overlays(spark, made):
    df = clusters.overlays(table(spark, made), "v", 0.45)
    got = {n: arrays(df, n, made, bool) for n in ("raw_hot", "z_supported_hot", "z_unsupported_hot", "xy_filled", "dominant_cluster", "dominant_core")}
    for c, (organ, v, pz, tz) in made.items():
        m, core, whole, _, rows = ranked(organ, v, pz, tz, 0.45)
        best = rows[0][1] if rows else np.zeros_like(m)
        want = {"raw_hot": m, "z_supported_hot": core, "z_unsupported_hot": m & ~core, "xy_filled": whole, "dominant_cluster": best, "dominant_core": best & core}
        assert all(np.array_equal(got[n][c], want[n]) for n in want)


def test_small_clusters_are_counted(spark, made):
    many = {r["case"]: r for r in clusters.dominant_clusters(table(spark, made), "v", "pz", "tz", 0.45, SPACING).collect()}
    few = {r["case"]: r for r in clusters.dominant_clusters(table(spark, made), "v", "pz", "tz", 0.45, SPACING, least_voxels=6).collect()}
    for c in made:
        sizes = [int(k[1].sum()) for k in ranked(*made[c], 0.45)[4]]
        assert few[c]["ignored_small_clusters"] == sum(s < 6 for s in sizes) and many[c]["valid_num_clusters"] == len(sizes)


def test_average_heat_and_largest_component(spark, made):
    cells = table(spark, made)
    r = np.random.default_rng(2)
    centres = [(c, *map(int, at), float("nan") if k % 9 == 0 else float(r.random())) for c, (organ, *_) in made.items() for k, at in enumerate(np.argwhere(organ)) if k % 3 == 0]
    patches = spark.createDataFrame([*centres, ("a", 0, 1, 1, 0.25)], "case string, z int, y int, x int, s double")
    got = arrays(clusters.average_heat(cells.select("case", "z", "y", "x", "organ"), patches, ["s"], (0, 1, 2)), "s", made)
    for c, (organ, *_) in made.items():
        for at in np.ndindex(organ.shape):
            cover = [s for d, z, y, x, s in [*centres, ("a", 0, 1, 1, 0.25)] if d == c and z == at[0] and abs(y - at[1]) <= 1 and abs(x - at[2]) <= 2 and np.isfinite(s)]
            assert got[c][at] == pytest.approx(np.mean(cover) if cover and organ[at] else 0)
    told = {x["case"]: x for x in clusters.largest_component(cells, "v", 0.5, SPACING).collect()}
    for c, (organ, v, *_) in made.items():
        label, n = parts(hot(v, organ, 0.5), False)
        assert told[c]["largest_hotspot_voxels"] == max([int((label == k).sum()) for k in range(1, n + 1)], default=0)


def test_case_summary_is_one_row_a_case(spark, made):
    cells = table(spark, made)
    patches = cells.filter("organ and x % 2 = 0 and case <> 'flat'").selectExpr("case", "z", "y", "x", "v cs", "1 - v non_cs", "pz", "tz")
    row = {r["case"]: r.asDict() for r in clusters.case_summary(cells.select("case", "z", "y", "x", "organ"), patches, (0, 1, 1), SPACING).collect()}
    assert set(row) == set(made) and row["flat"]["n_patches"] == 0 and row["flat"]["patch_cs_mean"] is None and row["flat"]["cluster_0_60_raw_hot_voxels"] == 0
    # Fourteen summaries of 23, four hot spots of 2, two zones of 10, three thresholds of 43, and two keys.
    assert len(row["a"]) == 14 * 23 + 4 * 2 + 2 * 10 + 3 * 43 + 2


def test_border_rule_of_a_row(spark):
    """A row of cells on the border doesn't survive a closing, as what lies outside counts as empty."""
    df = spark.createDataFrame([("a", 0, y, x, 1 if y == 0 else 0) for y in range(4) for x in range(5)], "case string, z int, y int, x int, m int")
    assert clusters.closed(df, "m", ("y", "x")).filter("m = 1").count() == 0


def test_ranking_carries_only_the_columns_it_reads(spark, made, monkeypatch):
    seen = []
    monkeypatch.setattr(clusters, "kept", lambda df, name: seen.append(df.columns) or df)
    clusters.dominant_clusters(table(spark, made).selectExpr("*", "v as heat", "pz * v as other"), "v", "pz", "tz", 0.45, SPACING)
    assert "_fill_label" in seen[0] and not {"heat", "other"} & set(seen[0])


def test_cells_kept_by_case_are_not_shuffled_again(spark, made):
    from pyspark.sql import functions as F

    told = clusters.kept(clusters.by_case(table(spark, made)), "cells")
    assert sorted(map(str, told.collect())) == sorted(map(str, table(spark, made).collect()))
    smooth = clusters.smoothed(told, "v")
    best = smooth.groupBy("case").agg(F.max("smooth").alias("m"))
    for df in (smooth, told.join(best, "case")):
        df.collect()
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gridloom_")]
