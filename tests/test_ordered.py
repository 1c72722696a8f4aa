"""Ranks, shares, curves and places in ranges, against plain loops, on groups that fill many ranges."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.operators import metrics, ordered
from gridloom.plans.aggregates import icc_table


@pytest.fixture
def ranges(spark):
    """Many small ranges, so that groups are cut."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "13"), strict=True):
        spark.conf.set(n, v)
    yield spark
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def rows(seed=3, n=700):
    """Two thirds in one group, a third with one value, nulls among groups and values."""
    r = random.Random(seed)
    made = []
    for k in range(n):
        g = None if k % 41 == 0 else "big" if k % 3 else f"g{k % 5}"
        v = None if k % 29 == 0 else 1.5 if k % 3 == 1 else round(r.gauss(0, 3), 1 if k % 2 else 6)
        made.append((k, g, v, int(r.random() < 0.4)))
    return [*made, (n, "alone", 4.0, 1), (n + 1, "nothing", None, 0), (n + 2, "same", 2.0, 1), (n + 3, "same", 2.0, 0), (n + 4, "zero", -0.0, 1), (n + 5, "zero", 0.0, 0), (n + 6, "far", math.inf, 1), (n + 7, "far", -math.inf, 0), (n + 8, "far", 0.0, 0)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, "id long, g string, v double, y int")


def by_group(data):
    found = {}
    for r in data:
        found.setdefault(r[1], []).append(r)
    return found


def test_ranks(ranges):
    got = {r["id"]: r["r"] for r in ordered.rank01(table(ranges), "v", ["g"], "r").collect()}
    assert len(got) == len(rows())
    for members in by_group(rows()).values():
        known = sorted(r[2] for r in members if r[2] is not None)
        for i, _, v, _ in members:
            want = 0.5
            if v is not None and len(known) > 1:
                places = [k for k, other in enumerate(known) if other == v]
                want = sum(places) / len(places) / (len(known) - 1)
            assert got[i] == pytest.approx(want)


def test_groups_are_cut_into_ranges(ranges):
    per = table(ranges).filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = ordered.in_ranges(per, ["g", "v"]).groupBy("g").agg(F.count_distinct(ordered.PART).alias("parts"), F.count(F.lit(1)).alias("n"), F.max("v").alias("hi")).collect()
    big = next(r for r in parts if r["g"] == "big")
    assert big["parts"] >= 5
    largest = ordered.in_ranges(per, ["g", "v"]).groupBy(ordered.PART).count().agg(F.max("count")).first()[0]
    assert largest < big["n"] / 2


def test_no_window_over_a_bare_group(ranges):
    plan = ordered.running(table(ranges).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), ["g"], "v", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # Windows over a group alone order its ranges, of which there are few; values are ordered inside a range.
    assert any("[g#" in w and f"{ordered.PART}#" in w.rsplit("], [", 2)[-2] for w in windows)
    assert all(f"{ordered.PART}#" in w or "n_all" in w for w in windows)


def test_running_sums_both_ways(ranges):
    per = table(ranges).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    for down in (False, True):
        got = {(r["g"], r["v"]): (r["n_upto"], r["s_upto"], r["n_all"], r["s_all"]) for r in ordered.running(per, ["g"], "v", ["n", "s"], down).collect()}
        for g, members in by_group(rows()).items():
            before = (lambda a, b: (b is None or (a is not None and a >= b))) if not down else (lambda a, b: a is None or (b is not None and b >= a))
            for v in {r[2] for r in members}:
                upto = [r for r in members if before(v, r[2])]
                assert got[g, v] == (len(upto), sum(r[3] for r in upto), len(members), sum(r[3] for r in members)), (g, v, down)


def test_shares_of_a_reference(ranges):
    data = rows()
    reference = [r for r in data if r[0] % 3 == 0 and r[1] != "alone" and r[2] is not None]
    asked = [r for r in data if r[0] % 3 and r[2] is not None]
    got = {r["id"]: r["u"] for r in ordered.ecdf(table(ranges, reference), table(ranges, asked), ["g"], "v", "u").collect()}
    assert set(got) == {r[0] for r in asked}
    by = by_group(reference)
    for i, g, v, _ in asked:
        ref = [r[2] for r in by.get(g, [])]
        if not ref:
            assert got[i] is None
        elif len(set(ref)) == 1:
            assert got[i] == 0.5
        else:
            assert got[i] == pytest.approx(min(max(sum(x <= v for x in ref) / len(ref), 0.5 / len(ref)), 1 - 0.5 / len(ref)))


def test_curves_and_areas(ranges):
    data = [r for r in rows() if r[2] is not None]
    points = {(r["g"], r["score"]): (r["tp"], r["fp"], r["pos"], r["neg"]) for r in metrics.curve_points(table(ranges), ["g"], "y", "v").collect()}
    areas = {r["g"]: r["auc"] for r in metrics.auc_ap(table(ranges).filter("g is not null"), ["g"], "y", "v").collect()}
    for g, members in by_group(data).items():
        pos, neg = [r[2] for r in members if r[3]], [r[2] for r in members if not r[3]]
        for v in {r[2] for r in members}:
            assert points[g, v] == (sum(x >= v for x in pos), sum(x >= v for x in neg), len(pos), len(neg))
        if g is not None:
            pairs = [(a > b) + (a == b) / 2 for a in pos for b in neg]
            assert areas[g] == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)


def test_places(ranges):
    got = sorted((r["g"] or "", r["n"], r["v"], r["id"]) for r in ordered.numbered(table(ranges).filter("v is not null"), ["v", "id"], "n", ["g"]).collect())
    for g, members in by_group([r for r in rows() if r[2] is not None]).items():
        want = [(k + 1, r[2] + 0.0, r[0]) for k, r in enumerate(sorted(members, key=lambda r: (r[2], r[0])))]
        assert [(n, v + 0.0, i) for h, n, v, i in got if h == (g or "")] == want
    whole = ordered.numbered(table(ranges), ["id"], "n").collect()
    assert {(r["id"], r["n"]) for r in whole} == {(k, k + 1) for k in range(len(rows()))}


def test_empty_tables(spark):
    none = table(spark, [])
    assert ordered.rank01(none, "v", ["g"], "r").count() == 0
    assert ordered.ecdf(none, table(spark), ["g"], "v", "u").filter("u is not null").count() == 0
    assert ordered.numbered(none, ["id"], "n").count() == 0
    assert metrics.auc_ap(none, ["g"], "y", "v").count() == 0


def test_medians_are_exact_whatever_the_approximate_ends(spark):
    r = random.Random(5)
    groups = {"many": [r.random() for _ in range(4001)], "even": [r.choice((1.0, 2.0)) for _ in range(1000)] + [7.5] * 1000, "one": [3.0], "two": [1.0, 4.0], "flat": [2.0] * 50, "null": [None, None], "skew": [0.0] * 7 + [9.0] * 7}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    want = {g: statistics.median(vs) for g, vs in groups.items() if vs[0] is not None}
    for accuracy in (10_000, 200, 40):
        assert {x["g"]: x["m"] for x in ordered.medians(df, ["g"], "v", "m", accuracy).collect()} == pytest.approx(want, abs=0, rel=0)


def test_raters_meet_without_shuffling_their_long_form(spark):
    rows = [(k, float(k % 7), float(k)) for k in range(500)]
    a, b = (spark.createDataFrame([(k, x + s, y) for k, x, y in rows], "id long, p double, q double") for s in (0.0, 0.5))
    told = {x["feature"]: x for x in icc_table(a, b, ["id"], ["p", "q"]).collect()}
    assert told["q"]["icc"] == pytest.approx(1.0) and told["p"]["stable"] and told["q"]["constant_share"] == pytest.approx(1 / 500, abs=0.05)
    plan = icc_table(a, b, ["id"], ["p", "q"])._jdf.queryExecution().optimizedPlan().toString()
    assert "id#" not in plan
