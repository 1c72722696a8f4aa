"""Stores under failures between their writes."""

import pytest
from pyspark.sql import DataFrameWriter

from gridloom.sources import models, tables


def made(spark, n):
    return lambda: spark.range(n)


def test_models_of_other_settings_are_never_taken(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    first, there = models.stored_or_fitted(spark, path, {"seed": 1}, made(spark, 1))
    assert (first.count(), there) == (1, False)

    def stops(self, *args, **kw):
        raise OSError("stopped before the record")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "text", stops)
        with pytest.raises(OSError, match="stopped"):
            models.stored_or_fitted(spark, path, {"seed": 2}, made(spark, 5))
    again, there = models.stored_or_fitted(spark, path, {"seed": 1}, made(spark, 99))
    assert (again.count(), there) == (1, True), "the older settings keep their own models"
    other, there = models.stored_or_fitted(spark, path, {"seed": 2}, made(spark, 7))
    assert (other.count(), there) == (7, False), "models without a record are made anew"
    assert models.stored_or_fitted(spark, path, {"seed": 2}, made(spark, 99))[1]


def test_splits_are_replaced_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/splits"
    one = spark.createDataFrame([(0, ["a"], ["b"], [])], tables.SPLITS)
    two = spark.createDataFrame([(0, ["c"], ["d"], []), (1, ["d"], ["c"], [])], tables.SPLITS)
    tables.write_splits(one, path)
    tables.write_splits(two, path)
    assert {tuple(r["train_case_ids"]) for r in tables.read_splits(spark, path).collect()} == {("c",), ("d",)}
    stays = tables.read_or_build_splits(spark, path, lambda: one)
    assert stays.count() == 2


def test_sheets_are_published_as_one_unit(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/book"
    sheet = lambda *values: spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    kind = sheet(1.0).schema
    read = lambda name: sorted(r["v"] for r in tables.read_sheet(spark, path, name, kind).collect())
    tables.write_sheets(path, {"folds": sheet(0.123456, 2.0), "summary": sheet(1.0)}, places=4)
    assert read("folds") == [0.1235, 2.0] and read("summary") == [1.0] and read("gone") == []

    whole, calls = DataFrameWriter.parquet, []

    def second_stops(self, *args, **kw):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("stopped between the sheets")
        return whole(self, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", second_stops)
        with pytest.raises(OSError, match="between"):
            tables.write_sheets(path, {"folds": sheet(7.0), "summary": sheet(8.0)})
    assert read("folds") == [0.1235, 2.0] and read("summary") == [1.0], "neither sheet of the broken set is seen"

    def manifest_stops(self, *args, **kw):
        raise OSError("stopped before the manifest")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "json", manifest_stops)
        with pytest.raises(OSError, match="before the manifest"):
            tables.write_sheets(path, {"folds": sheet(7.0), "summary": sheet(8.0)})
    assert read("folds") == [0.1235, 2.0]
    tables.write_sheets(path, {"folds": sheet(7.0)})
    assert read("folds") == [7.0] and read("summary") == [], "a set replaces all of the set before"
    with pytest.raises(ValueError, match="31"):
        tables.write_sheets(path, {"x" * 32: sheet(1.0), "x" * 31 + "y": sheet(1.0)})


def test_a_batch_reads_the_folders_of_its_own_keys(spark, tmp_path):
    from gridloom.streaming import resume

    path, rows = f"{tmp_path}/sink", spark.range(300).selectExpr("id", "id * 2 v")
    resume.append_missing(rows, path, "id")
    files = {str(p) for p in (tmp_path / "sink").rglob("*.parquet")}
    assert len({p.rsplit("/", 2)[1] for p in files}) == resume.BUCKETS
    few = spark.createDataFrame([(3, 0), (3, 1), (1000, 5)], "id long, v long")
    touched = {r[0] for r in few.selectExpr(f"pmod(xxhash64(id), {resume.BUCKETS})").collect()}
    held = resume.held_keys(spark, path, few.select("id").schema, sorted(touched))
    assert {p.rsplit("/", 2)[1] for p in held.inputFiles()} == {f"{resume.BUCKET}={b}" for b in touched}
    resume.append_missing(few, path, "id")
    resume.append_missing(few, path, "id")
    got = resume.published(spark, path, rows.schema)
    assert got.count() == 301 and got.filter("id = 3").first()["v"] == 6


def test_volumes_keep_their_place(spark):
    import numpy as np

    from gridloom.sources import volumes

    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    content = volumes.encode(x, (3.0, 0.5, 0.25), True, (1.5, -2.0, 1e-9), turn)
    values, spacing = volumes.decode(content)
    assert np.array_equal(values, x) and spacing == (3.0, 0.5, 0.25) and volumes.placement(content) == ([1.5, -2.0, 1e-9], turn)
    # The file holds the matrix axis by axis.
    assert b"TransformMatrix = 0.0 1.0 0.0 -1.0 0.0 0.0 0.0 0.0 1.0" in content
    bare = b"NDims = 2\nDimSize = 2 1\nElementType = MET_UCHAR\nElementDataFile = LOCAL\n\x01\x02"
    assert volumes.placement(bare) == ([0.0, 0.0, 0.0], volumes.NOWHERE[1])
    plane = volumes.encode(x[0], (0.5, 0.25), False, (4.0, 5.0, 6.0), turn)
    assert volumes.placement(plane) == ([4.0, 5.0, 0.0], turn)
    files = spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"no volume"))], "case_id string, content binary")
    rows = volumes.scan(volumes.encoded(volumes.scan(files)).select("case_id", "content")).collect()
    assert len(rows) == 2 and all(r["origin"] == [1.5, -2.0, 1e-9] and r["direction"] == turn for r in rows)
