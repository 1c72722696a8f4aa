"""Patch and ring features against numpy on each patch."""

import math

import numpy as np
import pytest

from gridloom.operators import contexts

EPS = 1e-12


def stats15(x):
    x = x[np.isfinite(x)]
    q = np.percentile(x, [10, 25, 75, 90])
    d, sd = x - x.mean(), x.std()
    return {
        "mean": x.mean(), "std": sd, "var": x.var(), "min": x.min(), "max": x.max(), "median": np.median(x), "p10": q[0], "p25": q[1], "p75": q[2], "p90": q[3], "iqr": q[2] - q[1],
        "skew": (d**3).mean() / sd**3 if sd > EPS else 0, "kurt": (d**4).mean() / sd**4 if sd > EPS else 0, "rms": math.sqrt((x * x).mean()), "energy": (x * x).mean(),
    }


def gradient(p):
    if min(p.shape[1:]) < 2:
        return np.full(p.shape, np.nan)
    axes = [a for a in range(3) if p.shape[a] > 1]
    return np.sqrt(sum(np.gradient(p, axis=a) ** 2 for a in axes))


def glcm(img):
    lo, hi = img.min(), img.max()
    q = np.zeros(img.shape, int) if hi - lo < EPS else np.clip(np.floor((img - lo) / (hi - lo + EPS) * 16), 0, 15).astype(int)
    n = np.zeros((16, 16))
    h, w = q.shape
    for y in range(h):
        for x in range(w):
            for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    a, b = q[y, x], q[y + dy, x + dx]
                    n[a, b] += 1
                    n[b, a] += 1
    if not n.sum():
        return {}
    p = n / n.sum()
    i, j = np.indices(p.shape)
    mu, asm = (p * i).sum(), (p * p).sum()
    sd = math.sqrt((p * (i - mu) ** 2).sum() + EPS)
    return {
        "contrast": (p * (i - j) ** 2).sum(), "dissimilarity": (p * abs(i - j)).sum(), "homogeneity": (p / (1 + abs(i - j))).sum(), "asm": asm, "energy": math.sqrt(asm),
        "entropy": -(p[p > 0] * np.log(p[p > 0])).sum(), "correlation": (p * (i - mu) * (j - mu)).sum() / (sd * sd + EPS),
    }


def features(patch, inside, masked):
    made = {**stats15(patch[inside]), **{f"grad_{k}": v for k, v in stats15(gradient(patch)[inside]).items()}}
    img, own = patch[len(patch) // 2], inside[len(patch) // 2]
    if masked:
        if not own.any():
            return made
        at = np.argwhere(own)
        (y0, x0), (y1, x1) = at.min(0), at.max(0) + 1
        img, own = img[y0:y1, x0:x1].copy(), own[y0:y1, x0:x1]
        img[~own] = np.median(img[own])
    return made | {f"glcm_{k}": v for k, v in glcm(img).items()}


@pytest.mark.parametrize(("shape", "radius"), [((3, 7, 6), (0, 1, 1)), ((4, 6, 6), (1, 1, 2)), ((1, 5, 5), (1, 1, 1))])
def test_every_feature_of_every_centre(spark, shape, radius):
    r = np.random.default_rng(sum(shape))
    a, b = r.normal(size=shape), np.round(r.random(shape), 1)
    cells = spark.createDataFrame([("c", *map(int, at), float(a[at]), float(b[at])) for at in np.ndindex(shape)], "case string, z int, y int, x int, a double, b double")
    asked = [at for at in np.ndindex(shape) if (at[1] + at[2]) % 3 == 0]
    centres = spark.createDataFrame([("c", *map(int, at)) for at in asked], "case string, pz int, py int, px int")
    got = {(x["pz"], x["py"], x["px"]): x.asDict() for x in contexts.context_features(cells, centres, radius, "a", "b").collect()}
    assert set(got) == set(asked) and len(next(iter(got.values()))) == 301 + 4
    outer = [max(1, 2 * k) for k in radius]
    for at, row in got.items():
        box = lambda reach: tuple(slice(max(0, c - k), min(n, c + k + 1)) for c, k, n in zip(at, reach, shape, strict=True))  # noqa: B023, E731
        core, context = box(radius), box(outer)
        ring = np.ones(a[context].shape, bool)
        ring[tuple(slice(i.start - o.start, i.stop - o.start) for i, o in zip(core, context, strict=True))] = False
        for m, v in (("a", a), ("b", b)):
            inner = features(v[core], np.ones(v[core].shape, bool), False)
            outside = features(v[context], ring, True)
            for name in contexts.names():
                x, y = inner.get(name), outside.get(name)
                for key, want in ((f"{m}_core_{name}", x), (f"{m}_ring_{name}", y), (f"{m}_core_minus_ring_{name}", None if x is None or y is None else x - y)):
                    assert (row[key] is None) == (want is None), (at, key, row[key], want)
                    assert want is None or row[key] == pytest.approx(want, abs=1e-7), (at, key)
                if x is not None and y is not None and abs(y) > 1e-6:
                    assert row[f"{m}_core_ring_ratio_{name}"] == pytest.approx(x / (y + EPS), rel=1e-6)
        x, y = a[core].ravel(), b[core].ravel()
        assert row["a_b_core_corr"] == pytest.approx(np.corrcoef(x, y)[0, 1] if min(x.std(), y.std()) > EPS else 0)
        assert row["a_b_core_median_diff"] == pytest.approx(np.median(x) - np.median(y))
        assert row["a_b_core_mean_ratio"] == pytest.approx(x.mean() / (y.mean() + EPS))


def test_cells_stay_off_the_driver_and_sums_off_the_order_of_rows(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    rows = [(c, 0, y, x, *map(float, r.random(2))) for c in range(3) for y in range(7) for x in range(7)]
    cells = spark.createDataFrame(rows, "case long, z int, y int, x int, a double, b double")
    centres = cells.filter("y in (2, 4) and x in (2, 4)").select("case", F.col("z").alias("pz"), F.col("y").alias("py"), F.col("x").alias("px"))
    met = contexts.patches(cells, centres, (0, 1, 1), ("a", "b"))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    told = [{tuple(x[:4]) + (x["modality"], x["part"]): x["glcm_asm"] for x in contexts.texture(met.repartition(n, *by)).collect()} for n, by in ((1, ["case"]), (7, ["case", "v"]))]
    assert told[0] == told[1] and len(told[0]) == 48


def test_contexts_are_never_rows_and_cases_may_span_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(f"c{c}", z, y, x, *map(float, r.random(2))) for c in range(4) for z in range(2 + c) for y in range(6) for x in range(6)]
    # A missing value is no neighbour, a centre far from its case has no row, and neither has one without a case.
    rows[40] = (*rows[40][:4], None, 0.5)
    cells = spark.createDataFrame([*rows, (None, 0, 0, 0, 1.0, 1.0)], "case string, z int, y int, x int, a double, b double")
    centres = cells.filter("y % 2 = 1 and x % 2 = 1").select("case", F.col("z").alias("pz"), F.col("y").alias("py"), F.col("x").alias("px"))
    asked = centres.unionByName(spark.createDataFrame([("c0", 0, 40, 0), (None, 0, 1, 1), ("d", 0, 0, 0)], centres.schema))
    told = lambda: sorted(contexts.context_features(cells, asked, (0, 1, 1), "a", "b").collect(), key=lambda x: tuple(x[:4]))
    made = contexts.context_features(cells, asked, (0, 1, 1), "a", "b")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    whole = told()
    assert len(whole) == 9 * sum(2 + c for c in range(4))
    monkeypatch.setattr(contexts, "ROWS", 1)
    monkeypatch.setattr(contexts, "VALUES", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert told() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
