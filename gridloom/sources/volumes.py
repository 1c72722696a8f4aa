"""Volumes as tables of slices: MetaImage files in and out, spacing, and detections by case."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types of the MetaImage header.
ELEMENTS = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "<i2", "MET_USHORT": "<u2", "MET_INT": "<i4", "MET_UINT": "<u4", "MET_FLOAT": "<f4", "MET_DOUBLE": "<f8"}
SLICES = "case_id string, z int, h int, w int, sz double, sy double, sx double, v array<float>"


#: Where volumes lie: the first voxel's place by x, y and z, and the direction matrix, row by row.
PLACEMENT = "origin array<double>, direction array<double>"
NOWHERE = ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])


def header(content: bytes) -> tuple[dict[str, str], int]:
    """(fields of a MetaImage header, where its data begin)."""
    at, fields = 0, {}
    while True:
        end = content.index(b"\n", at)
        name, _, value = content[at:end].decode("ascii").partition("=")
        fields[name.strip()] = value.strip()
        at = end + 1
        if name.strip() == "ElementDataFile":
            return fields, at


def numbers(text: str) -> list[float]:
    return [float(n) for n in text.split()]


def decode(content: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """(values by z, y and x; spacing in that order) of a MetaImage file with its data inside, packed or not."""
    fields, at = header(content)
    size = [int(n) for n in fields["DimSize"].split()]
    raw = zlib.decompress(content[at:]) if fields.get("CompressedData", "False") == "True" else content[at:]
    values = np.frombuffer(raw, ELEMENTS[fields["ElementType"]], int(np.prod(size))).reshape(size[::-1])
    return values, tuple(numbers(fields.get("ElementSpacing", "1 1 1"))[::-1])


def placement(content: bytes) -> tuple[list[float], list[float]]:
    """(origin, direction matrix row by row) of a MetaImage file, which holds the matrix axis by axis; a plane's, or none, is completed."""
    fields, _ = header(content)
    named = next((fields[n] for n in ("Offset", "Origin", "Position") if n in fields), "")
    place, told = numbers(named), numbers(next((fields[n] for n in ("TransformMatrix", "Orientation", "Rotation") if n in fields), ""))
    matrix, n = np.eye(3), int(round(len(told) ** 0.5))
    if n and n * n == len(told):
        matrix[:n, :n] = np.array(told).reshape(n, n).T
    return [*place, *NOWHERE[0]][:3], matrix.ravel().tolist()


def encode(values: np.ndarray, spacing: Sequence[float], compress: bool = True, origin: Sequence[float] = NOWHERE[0], direction: Sequence[float] = NOWHERE[1]) -> bytes:
    """A MetaImage file of a volume; origin by x, y and z, direction row by row."""
    kind = next(k for k, d in ELEMENTS.items() if np.dtype(d) == values.dtype)
    data = values.tobytes()
    data = zlib.compress(data) if compress else data
    text = lambda numbers_: " ".join(repr(float(n)) for n in numbers_)
    axes = np.array(direction, float).reshape(3, 3)[: values.ndim, : values.ndim].T.ravel()
    fields = {
        "ObjectType": "Image", "NDims": values.ndim, "BinaryData": "True", "BinaryDataByteOrderMSB": "False", "CompressedData": compress, "TransformMatrix": text(axes), "Offset": text(origin[: values.ndim]),
        "ElementSpacing": text(spacing[::-1]), "DimSize": " ".join(map(str, values.shape[::-1])), "ElementType": kind, "ElementDataFile": "LOCAL",
    }
    return "".join(f"{k} = {v}\n" for k, v in fields.items()).encode() + data


def scan(files: DataFrame) -> DataFrame:
    """Slices of the volumes in (case_id, path, content), with where these lie; a file that can't be decoded gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for case, content in zip(batch["case_id"], batch["content"], strict=True):
                try:
                    values, (sz, sy, sx) = decode(bytes(content))
                    place, matrix = placement(bytes(content))
                except (ValueError, KeyError, UnicodeDecodeError, zlib.error):
                    continue
                values = values.reshape((1, *values.shape)) if values.ndim == 2 else values
                yield pd.DataFrame({
                    "case_id": case, "z": np.arange(len(values), dtype=np.int32), "h": np.int32(values.shape[1]), "w": np.int32(values.shape[2]),
                    "sz": sz, "sy": sy, "sx": sx, "v": [s.reshape(-1).astype(np.float32) for s in values], "origin": [place] * len(values), "direction": [matrix] * len(values),
                })

    return files.select("case_id", "content").mapInPandas(run, f"{SLICES}, {PLACEMENT}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mha").load(folder)
    return scan(files.select(F.regexp_extract("path", r"([^/]+)\.mha$", 1).alias("case_id"), "content"))


def voxels(slices: DataFrame) -> DataFrame:
    """One row a voxel."""
    at = slices.select("case_id", "z", "w", F.posexplode("v").alias("_i", "v"))
    return at.select("case_id", "z", F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"), (F.col("_i") % F.col("w")).cast("int").alias("x"), "v")


def same_shape(*tables: DataFrame) -> DataFrame:
    """Cases that every table has in one and the same shape."""
    shapes = None
    for k, t in enumerate(tables):
        s = t.groupBy("case_id").agg(F.concat_ws("x", F.max("z") + 1, F.max("h"), F.max("w")).alias(f"_s{k}"))
        shapes = s if shapes is None else shapes.join(s, "case_id")
    equal = F.lit(True)
    for k in range(1, len(tables)):
        equal = equal & (F.col("_s0") == F.col(f"_s{k}"))
    return shapes.filter(equal).select("case_id")


def encoded(slices: DataFrame) -> DataFrame:
    """(case_id, content): each case's slices as one MetaImage file, with origin and direction where the slices have them."""
    placed = {"origin", "direction"} <= set(slices.columns)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        first = pdf.iloc[0]
        values = np.stack([np.asarray(v, np.float32).reshape(first.h, first.w) for v in pdf["v"]])
        where = (first.origin, first.direction) if placed else NOWHERE
        return pd.DataFrame({"case_id": [first.case_id], "content": [encode(values, (first.sz, first.sy, first.sx), True, *where)]})

    return slices.groupBy("case_id").applyInPandas(pack, "case_id string, content binary")


def origin(start: Column, index: Column, spacing: Column, direction: Column) -> Column:
    """The place of a voxel: the origin plus the direction matrix (rows as arrays) times index by spacing."""
    step = F.zip_with(index, spacing, lambda i, s: i * s)
    moved = F.transform(direction, lambda row: F.aggregate(F.zip_with(row, step, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))
    return F.zip_with(start, moved, lambda a, b: a + b)


def resampled(slices: DataFrame, spacing: tuple[float, float, float], nearest: bool = False) -> DataFrame:
    """Volumes on a grid of another spacing: linear, or nearest for masks; 0 outside. The size is the rounded old extent."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        first = pdf.iloc[0]
        x = np.stack([np.asarray(v, np.float64).reshape(first.h, first.w) for v in pdf["v"]])
        for axis, (old, new) in enumerate(zip((first.sz, first.sy, first.sx), spacing, strict=True)):
            n = max(1, round(x.shape[axis] * old / new))
            at = np.arange(n) * new / old
            low = np.floor(at + (0.5 if nearest else 0)).astype(int)
            part = np.zeros(n) if nearest else at - low
            inside = at <= x.shape[axis] - 1 + (0.5 if nearest else 0)
            take = lambda k: np.take(x, np.clip(k, 0, x.shape[axis] - 1), axis)  # noqa: B023, E731
            shape = [-1 if a == axis else 1 for a in range(3)]
            x = (take(low) * (1 - part.reshape(shape)) + take(low + 1) * part.reshape(shape)) * inside.reshape(shape)
        return pd.DataFrame({
            "case_id": first.case_id, "z": np.arange(len(x), dtype=np.int32), "h": np.int32(x.shape[1]), "w": np.int32(x.shape[2]),
            "sz": spacing[0], "sy": spacing[1], "sx": spacing[2], "v": [s.reshape(-1).astype(np.float32) for s in x],
        })

    return slices.groupBy("case_id").applyInPandas(one, SLICES)


def detections(parts: Sequence[DataFrame], keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Score streams of the same detections side by side, non-finite scores as 0; ValueError where streams don't meet one to one."""
    joined, n = parts[0], parts[0].count()
    for p in parts[1:]:
        joined = joined.join(p, list(keys))
        if p.count() != n:
            raise ValueError("streams differ in length")
    if joined.count() != n:
        raise ValueError("streams don't align")
    clean = lambda c: F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)).cast("float").alias(c)
    return joined.select(*keys, *(clean(c) for c in scores))
