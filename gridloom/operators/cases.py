"""Patches, bags and heatmaps of a case: centres, labels, training choice, scoring and the summary row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grids
from .sampling import draw


def patch_centres(mask: DataFrame, radius: int, stride: int, least: float) -> DataFrame:
    """(case, y, x, overlap): centres on a lattice over the mask's box whose patch lies in the mask by at least a share.

    A case too small for any lattice centre keeps the cell next to its middle.
    """
    box = grids.bounding_box(mask)
    lattice = box.select("case", F.explode(F.sequence("y0", "y1", F.lit(stride))).alias("y"), "x0", "x1").select("case", "y", F.explode(F.sequence("x0", "x1", F.lit(stride))).alias("x"))
    middle = box.select("case", F.floor((F.col("y0") + F.col("y1")) / 2).cast("int").alias("y"), F.floor((F.col("x0") + F.col("x1")) / 2).cast("int").alias("x"))
    span = lambda a: F.explode(F.sequence(F.col(a) - radius, F.col(a) + radius))
    asked = lattice.unionByName(middle).distinct()
    cover = asked.select("case", F.col("y").alias("py"), F.col("x").alias("px"), span("y").alias("y"), "x").select("case", "py", "px", "y", span("x").alias("x"))
    found = cover.join(mask.select("case", "y", "x"), ["case", "y", "x"]).groupBy("case", "py", "px").agg((F.count(F.lit(1)) / float((2 * radius + 1) ** 2)).alias("overlap"))
    good = found.select("case", F.col("py").alias("y"), F.col("px").alias("x"), "overlap")
    on = good.join(lattice, ["case", "y", "x"], "left_semi").filter(F.col("overlap") >= least)
    rest = good.join(middle, ["case", "y", "x"], "left_semi").join(on.select("case").distinct(), "case", "left_anti")
    return on.unionByName(rest)


def training_choice(patches: DataFrame, seed: int, most: int = 20, ratio: int = 2) -> DataFrame:
    """A case's training patches: up to ``most`` positives by overlap, ``ratio`` times as many negatives, half from either zone, what one zone lacks from the other.

    patches: case, y, x, cs_label, zone_label and lesion_overlap. The order among equals is keyed by the seed.
    """
    key = draw(seed, F.col("case").cast("string"), F.col("y").cast("string"), F.col("x").cast("string"))
    positive = patches.filter("cs_label = 1").withColumn("_n", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("lesion_overlap"), key, "y", "x"))).filter(F.col("_n") <= most).drop("_n")
    wanted = positive.groupBy("case").agg((F.count(F.lit(1)) * ratio).alias("_want"))
    negative = patches.filter("cs_label = 0").join(wanted, "case", "left").withColumn("_want", F.coalesce("_want", F.lit(most * ratio)))
    own = negative.withColumn("_z", F.coalesce("zone_label", F.lit(-1))).withColumn("_n", F.row_number().over(Window.partitionBy("case", "_z").orderBy(key, "y", "x")))
    late = (F.col("_z") < 0) | (F.col("_n") > F.ceil(F.col("_want") / 2))
    chosen = own.withColumn("_r", F.row_number().over(Window.partitionBy("case").orderBy(late, key, "y", "x"))).filter("_r <= _want")
    return positive.withColumn("patch_source", F.lit("positive")).unionByName(chosen.drop("_want", "_z", "_n", "_r").withColumn("patch_source", F.lit("negative")))


def summary_row(tables: dict[str, DataFrame]) -> DataFrame:
    """One wide row a case from tables keyed by case, columns prefixed by the table's name; cases of any table are in."""
    made = None
    for name, df in tables.items():
        one = df.select("case", *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "case"))
        made = one if made is None else made.join(one, "case", "full_outer")
    return made


def likelihoods(cs: Column, tz: Column) -> list[Column]:
    """Four scores of a patch from the chance of disease and that of the second zone."""
    return [cs.alias("cs"), (1 - cs).alias("non_cs"), (1 - tz).alias("pz"), tz.alias("tz"), (cs * (1 - tz)).alias("cs_pz"), (cs * tz).alias("cs_tz")]
