"""Neighbourhoods by windows along lines: against plain loops with gaps and radii beyond the array, in one shuffle by case."""

import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.operators import grids
from gridloom.plans.grids import volumes
from gridloom.plans.registry import Tables


def mirrored(p, n):
    p %= 2 * n
    return 2 * n - 1 - p if p >= n else p


def cells_of(shapes):
    return {(c, y, x): float((7 * y + 3 * x + c) % 11) for c, (h, w) in shapes.items() for y in range(h) for x in range(w) if (y + x + c) % 5 or (y, x) == (h - 1, w - 1)}


@pytest.mark.parametrize("radius", [1, 3])
def test_local_statistics(spark, radius):
    cells = cells_of({0: (4, 5), 1: (1, 2), 2: (2, 6)})
    rows = {(r["case"], r["y"], r["x"]): r for r in grids.local_statistics(spark.createDataFrame([(*k, v) for k, v in cells.items()], "case long, y int, x int, v double"), radius).collect()}
    assert set(rows) == set(cells)
    for (c, y, x), r in rows.items():
        h, w = (1 + max(k[a] for k in cells if k[0] == c) for a in (1, 2))
        near = [cells[at] for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if (at := (c, mirrored(y + dy, h), mirrored(x + dx, w))) in cells]
        assert (r["mean"], r["std"], r["median"], r["range"]) == pytest.approx((statistics.mean(near), statistics.pstdev(near), statistics.median(near), max(near) - min(near)))


def test_neighbours_move_no_cell(spark, tmp_path):
    spark.createDataFrame([(k, [float(i % 9) for i in range(64)]) for k in range(8)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = grids.laws(volumes(Tables(spark, str(tmp_path))), "E5L5S5").agg(F.sum("v"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
