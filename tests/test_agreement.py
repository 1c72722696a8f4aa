"""Agreement of scales at thresholds, where the last bit of a percentile decides."""

import duckdb
import pytest

from gridloom.plans.catalogue import ORACLE, QUERIES


def test_percentiles_at_a_threshold_fall_on_the_same_side_as_in_sql(spark, tmp_path):
    # Two values whose 95th percentile is 0.6, 0.7 or 0.8 but for the last bit.
    pairs = [(40.05, 61.05), (59.17, 70.57), (60.05, 81.05), (61.00, 81.00), (61.95, 80.95), (69.17, 80.57)]
    rows = [(user, "view", value) for user, pair in enumerate(pairs) for value in pair]
    # Several scales, a single value, values above the cap, missing ones and a scale of nothing else.
    rows += [(9, t, v) for t, v in (("view", 30.0), ("click", 250.0), ("click", None), ("error", None), ("error", None), ("signup", 12.5), ("signup", 99.99))]
    rows += [(10, t, float(k)) for t, n in (("view", 13), ("click", 21), ("error", 41)) for k in range(n)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/*.parquet'")
    want = con.sql(ORACLE["a13_scale_agreement"]).df().set_index("user_id").sort_index()
    got = QUERIES["a13_scale_agreement"](spark, str(tmp_path)).toPandas().set_index("user_id").sort_index()
    assert sorted(got.columns) == sorted(want.columns) and got.index.equals(want.index)
    for c in want.columns:
        assert got[c].astype(float).tolist() == pytest.approx(want[c].astype(float).tolist(), abs=0, rel=0, nan_ok=True), c
