"""Texture and topology tables of volumes, one grouped task a case."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textures

STATISTICS = ("kurt", "median", "skew", "var")


#: Numbers of maps at masked voxels that a task holds before it takes their statistics.
MAPS = 1 << 22


def texture_rows(slices: DataFrame, specs: Sequence[dict], margin: int = 8) -> DataFrame:
    """(case_id, v): four statistics of each map over each case's mask in one array, the maps in the order of the specs.

    slices: case_id, z, h, w, sz, sy, sx, v and mask (arrays of equal length). Only the given
    specs are worked out, on the mask's box with a margin; a case without mask has nulls.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        first = pdf.iloc[0]
        stack = lambda c: np.stack(pdf[c].to_numpy()).astype(np.float64).reshape(len(pdf), first.h, first.w)
        x, mask = stack("v"), stack("mask") > 0
        told = np.full((len(specs), len(STATISTICS)), np.nan)
        if mask.any():
            box = tuple(slice(max(0, int(k.min()) - margin), int(k.max()) + margin + 1) for k in np.nonzero(mask))
            x, mask = x[box], mask[box]
            held: dict = {}
            step = max(1, MAPS // int(mask.sum()))
            for begin in range(0, len(specs), step):
                some = specs[begin : begin + step]
                told[begin : begin + step] = textures.fours(np.stack([textures.texture_map(x, mask, s, (first.sz, first.sy, first.sx), held) for s in some]))
        flat = told.ravel()
        return pd.DataFrame({"case_id": [first.case_id], "v": [flat if not np.isnan(flat).any() else [None if np.isnan(v) else v for v in flat]]})

    return spread(slices).groupBy("case_id").applyInPandas(one, "case_id string, v array<double>")


def spread(slices: DataFrame) -> DataFrame:
    """slices, dealt by case into as many parts as shuffles have and twice the cores at least: few bytes make long work here, so parts mustn't be joined by their bytes."""
    spark = slices.sparkSession
    return slices.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "case_id")


def texture_names(specs: Sequence[dict]) -> list[str]:
    return [f"{s['name']}_{x}" for s in specs for x in STATISTICS]


def texture_table(slices: DataFrame, specs: Sequence[dict] | None = None, margin: int = 8) -> DataFrame:
    """(case_id, feature, value): ``texture_rows`` with a row a statistic; a case without mask has nulls."""
    wanted = list(specs or textures.catalogue())
    named = F.arrays_zip(F.array(*map(F.lit, texture_names(wanted))).alias("feature"), F.col("v").alias("value"))
    return texture_rows(slices, wanted, margin).select("case_id", F.inline(named))


def texture_columns(slices: DataFrame, specs: Sequence[dict] | None = None, margin: int = 8) -> DataFrame:
    """One row a case with a column a statistic, named as in ``texture_table``; the rows leave their tasks as wide ones and aren't shuffled again."""
    wanted = list(specs or textures.catalogue())
    rows = texture_rows(slices, wanted, margin)
    return rows.select("case_id", *(F.col("v")[k].alias(name) for k, name in enumerate(texture_names(wanted))))


def topology_table(slices: DataFrame, levels: int = 4) -> DataFrame:
    """(case_id, level, volume, surface, euler, mean, max, total, skew, kurt): shape and intensity of each case's mask over a pyramid whose levels halve the grid."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        first = pdf.iloc[0]
        stack = lambda c: np.stack([np.asarray(a, np.float64).reshape(first.h, first.w) for a in pdf[c]])
        x, mask, spacing = stack("v"), stack("mask") > 0, np.array([first.sz, first.sy, first.sx])
        rows = []
        for level in range(levels):
            v = x[mask]
            sd = v.std() if len(v) else 0.0
            d = v - v.mean() if len(v) else v
            shape = (float(mask.sum() * spacing.prod()), textures.surface(mask, spacing), textures.euler(mask))
            figures = (v.mean(), v.max(), v.sum(), (d**3).mean() / (sd**3 + textures.EPS), (d**4).mean() / (sd**4 + textures.EPS)) if len(v) else (0.0,) * 5
            rows.append((first.case_id, level, *shape, *map(float, figures)))
            for axis in range(3):
                x = textures.along(x, (0.25, 0.5, 0.25), axis)
            halves = tuple(slice(0, 2 * max(1, n // 2), 2) for n in x.shape)
            x, mask, spacing = x[halves], mask[halves], spacing * 2
        return pd.DataFrame(rows, columns=["case_id", "level", "volume", "surface", "euler", "mean", "max", "total", "skew", "kurt"])

    return spread(slices).groupBy("case_id").applyInPandas(one, "case_id string, level int, volume double, surface double, euler int, mean double, max double, total double, skew double, kurt double")
