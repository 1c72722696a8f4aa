"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import glob
import os

import duckdb
import pytest

from gridloom.plans.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    try:
        return round(float(v), 5) + 0.0
    except (TypeError, ValueError):
        return str(v)


def ordered(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    want, got = duck.sql(ORACLE[name]).df(), QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
