"""Masked smoothing, bounded morphology and ranked clusters of volumes held as dense cells: (case, z, y, x, ...).

A case's cells are its whole array, so its border is where its cells end. Windows run along
lines of cells, one axis after another, so a box of any radius costs three passes and no
cell is multiplied. All windows and groups of a case meet in one shuffle by case, and a case,
one volume, is what a task holds where holes are filled and components are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..session import dealt, spread
from .grids import component_numbers, components
from .summaries import score_summary

AXES = ("z", "y", "x")
EPS = 1e-12


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept by case, so that what reads it shuffles no cell."""
    return dealt(df, "case", name)


def by_case(df: DataFrame) -> DataFrame:
    """df dealt by case as kept tables are; if it is so already, no row moves."""
    return df.repartition(spread(df.sparkSession), "case")


def line(axis: str):
    """The cells of a case along an axis, in order."""
    return Window.partitionBy("case", *(a for a in AXES if a != axis)).orderBy(axis)


def gaussian(sigma: float, reach: float = 4.0) -> list[float]:
    """Weights of a Gaussian out to so many deviations, with a sum of 1."""
    r = int(reach * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return [float(v) for v in w / w.sum()]


def convolved(df: DataFrame, columns: Sequence[str], axis: str, kernel: Sequence[float]) -> DataFrame:
    """Each column's weighted sum along an axis; beyond the ends the end's value counts on."""
    w, r = line(axis), len(kernel) // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def at(c: str, o: int) -> Column:
        if o == 0:
            return F.col(c)
        return F.coalesce(F.lag(c, -o).over(w), F.first(c).over(whole)) if o < 0 else F.coalesce(F.lead(c, o).over(w), F.last(c).over(whole))

    total = lambda c: sum((F.lit(g) * at(c, k - r) for k, g in enumerate(kernel)), F.lit(0.0))
    return df.withColumns({c: total(c) for c in columns})


def smoothed(df: DataFrame, value: str, organ: str = "organ", sigma: Sequence[float] = (0.5, 1.0, 1.0), out: str = "smooth") -> DataFrame:
    """df with ``out``: a Gaussian mean of the finite values inside the organ, from 0 to 1, and 0 outside it."""
    valid = F.coalesce(F.col(organ), F.lit(False)) & ~F.isnan(F.coalesce(F.col(value), F.lit(float("nan")))) & (F.abs(value) < F.lit(float("inf")))
    valid = F.coalesce(valid, F.lit(False))
    made = df.withColumns({"_num": F.when(valid, F.col(value)).otherwise(0.0), "_den": F.when(valid, 1.0).otherwise(0.0)})
    for axis, s in zip(AXES, sigma, strict=True):
        made = convolved(made, ["_num", "_den"], axis, gaussian(s))
    mean = F.when(F.col(organ) & (F.col("_den") > 1e-6), F.col("_num") / F.col("_den")).otherwise(0.0)
    return made.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).drop("_num", "_den")


def dilated(df: DataFrame, mask: str, axes: Sequence[str] = AXES, radius: int = 1) -> DataFrame:
    """df with the 0/1 column grown by a box."""
    for a in axes:
        df = df.withColumn(mask, F.max(mask).over(line(a).rangeBetween(-radius, radius)))
    return df


def eroded(df: DataFrame, mask: str, axes: Sequence[str] = AXES, radius: int = 1) -> DataFrame:
    """df with the 0/1 column cut back to cells whose whole box is in it; outside the array nothing is."""
    for a in axes:
        df = df.withColumn(mask, (F.sum(mask).over(line(a).rangeBetween(-radius, radius)) == 2 * radius + 1).cast("int"))
    return df


def closed(df: DataFrame, mask: str, axes: Sequence[str] = AXES, radius: int = 1) -> DataFrame:
    return eroded(dilated(df, mask, axes, radius), mask, axes, radius)


def layer_supported(df: DataFrame, hot: str, out: str, radius: int = 1) -> DataFrame:
    """df with ``out``: hot cells with a hot cell within the radius in the layer before or after."""
    grown = dilated(df.withColumn("_grown", F.col(hot)), "_grown", ("y", "x"), radius)
    beside = lambda k: F.coalesce(F.max("_grown").over(line("z").rangeBetween(k, k)), F.lit(0))
    return grown.withColumn(out, (F.col(hot) * F.greatest(beside(-1), beside(1))).cast("int")).drop("_grown")


def without_holes(plane: np.ndarray) -> np.ndarray:
    """A plane's mask with the background that doesn't reach the border by faces."""
    filled = plane.copy()
    at = np.argwhere(~plane)
    if len(at):
        numbers = component_numbers(at, full=False)
        edge = ((at == 0) | (at == np.array(plane.shape) - 1)).any(axis=1)
        inside = ~np.isin(numbers, numbers[edge])
        filled[tuple(at[inside].T)] = True
    return filled


def filled(df: DataFrame, masks: Sequence[str], organ: str = "organ", labels: Sequence[str] = ()) -> DataFrame:
    """df with the holes of each 0/1 column filled, layer by layer, inside the organ; and, for those in ``labels``, ``{mask}_label``.

    Labels are from 1 in each case, by first cell, of cells that touch at a face, an edge or a corner; 0 elsewhere.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{m}_label", T.IntegerType()) for m in labels)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(AXES), kind="stable").reset_index(drop=True)
        at = pdf[list(AXES)].to_numpy()
        at = at - at.min(axis=0)
        place = tuple(at.T)
        inside = np.zeros(at.max(axis=0) + 1, bool)
        inside[place] = pdf[organ].to_numpy(bool)
        for m in masks:
            mask = np.zeros(inside.shape, bool)
            mask[place] = pdf[m].to_numpy(bool)
            mask = np.stack([without_holes(p) for p in mask & inside]) & inside
            own = mask[place]
            pdf[m] = own.astype(np.int32)
            if m in labels:
                numbers = np.zeros(len(pdf), np.int32)
                if own.any():
                    numbers[own] = component_numbers(at[own], full=True)
                pdf[f"{m}_label"] = numbers
        return pdf[schema.names]

    return df.groupBy("case").applyInPandas(run, schema)


def at_least(value: str, threshold: float, organ: str = "organ") -> Column:
    """0/1: a finite value at or above the threshold inside the organ."""
    v = F.col(value)
    return F.coalesce(F.col(organ) & v.isNotNull() & ~F.isnan(v) & (v < F.lit(float("inf"))) & (v >= threshold), F.lit(False)).cast("int")


def zone_continuity(cells: DataFrame, value: str, threshold: float, spacing: Sequence[float], organ: str = "organ") -> DataFrame:
    """Per case the hot cells, those after closing and filling, how many more these are, and the largest component's cells, volume,
    layers, mean, largest and 90th percentile value, and the share of the organ that is filled; zeros without hot cells."""
    marked = by_case(cells.select("case", *AXES, *dict.fromkeys((organ, value)))).withColumn("_raw", at_least(value, threshold, organ))
    shut = closed(marked.withColumn("_fill", F.col("_raw")), "_fill").withColumn("_fill", F.col("_fill") * F.col(organ).cast("int"))
    told = kept(filled(shut.select("case", *AXES, organ, value, "_raw", "_fill"), ["_fill"], organ, ["_fill"]), "continuity")
    sizes = told.filter("_fill_label > 0").groupBy("case", "_fill_label").agg(
        F.count(F.lit(1)).alias("largest_voxels"), F.count_distinct("z").alias("largest_layers"), F.avg(stats.finite(F.col(value))).alias("largest_mean"),
        F.max(stats.finite(F.col(value))).alias("largest_max"), stats.quantile(stats.finite(F.col(value)), 0.9).alias("largest_p90"),
    )
    best = sizes.withColumn("_n", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("largest_voxels"), "_fill_label"))).filter("_n = 1").drop("_n", "_fill_label")
    whole = told.groupBy("case").agg(F.sum("_raw").alias("raw_voxels"), F.sum("_fill").alias("smoothed_voxels"), F.sum(F.col(organ).cast("int")).alias("_organ"))
    made = whole.join(best, "case", "left").na.fill(0)
    gap, density = F.greatest(F.col("smoothed_voxels") - F.col("raw_voxels"), F.lit(0)), F.col("smoothed_voxels") / F.greatest(F.lit(1), F.col("_organ"))
    volume = F.col("largest_voxels") * F.lit(float(np.prod(spacing)))
    return made.withColumns({"filled_gap_voxels": gap, "largest_mm3": volume, "smooth_density": density}).drop("_organ")


#: What a cluster's score is made of, and the sizes at which its volume and layers count in full.
WEIGHTS = {"core_mean": 0.35, "core_p90": 0.25, "top10": 0.15, "max": 0.10, "volume": 0.08, "layers": 0.04, "core_share": 0.03}
FULL_VOXELS, FULL_LAYERS = 1000.0, 5.0


def cluster_table(told: DataFrame, value: str, core: str, label: str, spacing: Sequence[float]) -> DataFrame:
    """A row a cluster with its size, values, core and ranking score."""
    v = stats.finite(F.col(value))
    size = Window.partitionBy("case", label)
    ranked = told.filter(F.col(label) > 0).withColumn("_v", v).withColumn("_n", F.count("_v").over(size)).withColumn("_at", F.row_number().over(size.orderBy(F.col("_v").desc_nulls_last())))
    inner = F.when(F.col(core) == 1, F.col("_v"))
    top = F.when(F.col("_at") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.1)), F.col("_v"))
    made = ranked.groupBy("case", F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("voxels"), F.sum(F.col(core)).alias("core_voxels"), F.count_distinct("z").alias("z_slices"), (F.max("z") - F.min("z") + 1).alias("_span"), F.avg("_v").alias("mean"),
        F.max("_v").alias("max"), stats.quantile(F.col("_v"), 0.9).alias("p90"), F.avg(top).alias("top10"), F.avg(inner).alias("_core_mean"), stats.quantile(inner, 0.9).alias("_core_p90"),
    )
    made = made.filter("mean is not null").withColumns({"core_mean": F.coalesce("_core_mean", "mean"), "core_p90": F.coalesce("_core_p90", "p90"), "gap_voxels": F.col("voxels") - F.col("core_voxels"),
        "mm3": F.col("voxels") * F.lit(float(np.prod(spacing))), "z_span_mm": F.col("_span") * F.lit(float(spacing[0]))})
    parts = {
        "core_mean": F.col("core_mean"), "core_p90": F.col("core_p90"), "top10": F.col("top10"), "max": F.col("max"), "layers": F.least(F.lit(1.0), F.col("z_slices") / FULL_LAYERS),
        "volume": F.least(F.lit(1.0), F.log1p(F.col("voxels").cast("double")) / float(np.log1p(FULL_VOXELS))), "core_share": F.col("core_voxels") / F.col("voxels"),
    }
    return made.withColumn("score", sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))).drop("_span", "_core_mean", "_core_p90")


BEST = {
    "score": "score", "voxels": "voxels", "mm3": "mm3", "z_slices": "z_slices", "z_span_mm": "z_span_mm", "mean": "mean", "max": "max", "p90": "p90", "top10_mean": "top10",
    "core_hot_voxels": "core_voxels", "filled_gap_voxels": "gap_voxels", "core_mean": "core_mean", "core_p90": "core_p90",
}


def dominant_clusters(
    cells: DataFrame, value: str, first_zone: str, second_zone: str, threshold: float, spacing: Sequence[float], organ: str = "organ", least_voxels: int = 1, confidence: float = 0.65, radius: int = 1,
) -> DataFrame:
    """One row a case: how its hot clusters rank, what the best is made of, and which zone it lies in.

    Hot cells need a hot neighbour in the next layer; these are closed and filled layer by
    layer and joined into clusters in 3-D. The zone is told by both zones' scores weighted by
    the value over the best cluster: code 0 or 1, 0.5 where neither share reaches the
    confidence, and -1 without a cluster or scores. Cases without hot cells have zeros.
    """
    own = by_case(cells.select("case", *AXES, *dict.fromkeys((organ, value, first_zone, second_zone))))
    marked = layer_supported(own.withColumn("_raw", at_least(value, threshold, organ)), "_raw", "_core", radius)
    shut = closed(marked.withColumn("_fill", F.col("_core")), "_fill", ("y", "x"))
    zones = {"_zone0": first_zone, "_zone1": second_zone}
    for mask, zone in zones.items():
        shut = closed(shut.withColumn(mask, at_least(zone, 0.5, organ)), mask)
    told = kept(filled(shut, ["_fill", *zones], organ, ["_fill"]), "clusters")
    table = kept(cluster_table(told, value, "_core", "_fill_label", spacing), "cluster-table")
    valid = table.filter(F.col("voxels") >= least_voxels)
    ranked = valid.withColumn("_r", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("score"), "label")))
    of = lambda c, n: F.max(F.when(F.col("_r") == n, F.col(c)))
    upto = lambda f, c, n: f(F.when(F.col("_r") <= n, F.col(c)))
    summary = ranked.groupBy("case").agg(
        F.count(F.lit(1)).alias("valid_num_clusters"), *(of(c, 1).alias(f"best_cluster_{name}") for name, c in BEST.items()), of("label", 1).alias("_best"),
        F.coalesce(of("score", 2), F.lit(0.0)).alias("second_cluster_score"), F.coalesce(of("voxels", 2), F.lit(0)).alias("second_cluster_voxels"),
        (of("score", 1) / F.when(of("score", 2).isNull(), 1.0).otherwise(F.greatest(of("score", 2), F.lit(EPS)))).alias("dominance_ratio"),
        *(upto(F.avg, "score", n).alias(f"top{n}_cluster_score_mean") for n in (2, 3)), *(upto(F.sum, c, n).alias(f"top{n}_cluster_{c}_total") for c in ("voxels", "mm3") for n in (2, 3)),
        (of("score", 1) / F.greatest(upto(F.sum, "score", 3), F.lit(EPS))).alias("cluster_score_concentration"),
    ).withColumn("best_minus_second_cluster_score", F.col("best_cluster_score") - F.col("second_cluster_score"))
    whole = told.groupBy("case").agg(
        F.sum("_raw").alias("raw_hot_voxels"), F.sum("_core").alias("z_supported_hot_voxels"), F.sum(F.col("_raw") - F.col("_core")).alias("z_unsupported_hot_voxels"),
        F.sum("_fill").alias("xy_filled_cluster_voxels"), F.greatest(F.lit(0), F.sum(F.col("_fill") - F.col("_core"))).alias("xy_filled_gap_voxels"), F.max("_fill_label").alias("raw_num_clusters"),
    )
    small = table.groupBy("case").agg(F.count_if(F.col("voxels") < least_voxels).alias("ignored_small_clusters"))
    at = lambda c: F.coalesce(stats.finite(F.col(c)), F.lit(0.0))
    # By case alone, as a join on labels would move all cells.
    best = told.join(summary.select("case", "_best", F.col("best_cluster_voxels").alias("_size")), "case").filter("_fill_label = _best")
    zoned = best.groupBy("case", "_size").agg(*(F.sum(at(value) * at(zone)).alias(f"w{k}") for k, zone in enumerate(zones.values())), *(F.sum(mask).alias(f"m{k}") for k, mask in enumerate(zones)))
    both = F.col("w0") + F.col("w1")
    known = both > EPS
    share = [F.when(known, F.col(f"w{k}") / both).otherwise(0.0) for k in (0, 1)]
    certain = F.when(known & (share[0] >= confidence), 0.0).when(known & (share[1] >= confidence), 1.0)
    entropy = -(share[0] * F.ln(F.greatest(share[0], F.lit(EPS))) + share[1] * F.ln(F.greatest(share[1], F.lit(EPS))))
    zoned = zoned.select(
        "case", F.col("w0").alias("dominant_first_weighted_score"), F.col("w1").alias("dominant_second_weighted_score"), share[0].alias("dominant_first_ratio"), share[1].alias("dominant_second_ratio"),
        F.abs(share[0] - share[1]).alias("dominant_zone_margin"), F.when(known, entropy).otherwise(0.0).alias("dominant_zone_entropy"), F.when(known, F.coalesce(certain, F.lit(0.5))).otherwise(-1.0).alias("_code"),
        F.when(certain.isNull(), 1.0).otherwise(0.0).alias("dominant_zone_is_uncertain"), *((F.col(f"m{k}") / F.col("_size")).alias(f"dominant_{n}_mask_fraction") for k, n in enumerate(("first", "second"))),
    )
    made = whole.join(summary.drop("_best"), "case", "left").join(small, "case", "left").join(zoned, "case", "left")
    made = made.withColumn("dominant_zone_label_code", F.coalesce("_code", F.lit(-1.0))).drop("_code")
    alone = ((F.col("raw_hot_voxels") > 0) & (F.col("xy_filled_cluster_voxels") == 0)).cast("long")
    return made.withColumn("ignored_single_slice_clusters", alone).na.fill(0)


def overlays(cells: DataFrame, value: str, threshold: float, organ: str = "organ", least_voxels: int = 1, radius: int = 1) -> DataFrame:
    """cells with six 0/1 marks: hot, supported by the next layer or not, closed and filled, and the best cluster and its core."""
    marked = layer_supported(cells.withColumn("raw_hot", at_least(value, threshold, organ)), "raw_hot", "z_supported_hot", radius)
    told = filled(closed(marked.withColumn("xy_filled", F.col("z_supported_hot")), "xy_filled", ("y", "x")), ["xy_filled"], organ, ["xy_filled"])
    table = cluster_table(told, value, "z_supported_hot", "xy_filled_label", (1.0, 1.0, 1.0)).filter(F.col("voxels") >= least_voxels)
    best = table.groupBy("case").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("_best"))
    dominant = F.coalesce(F.col("xy_filled_label") == F.col("_best"), F.lit(False)).cast("int")
    made = told.join(best, "case", "left").withColumn("dominant_cluster", dominant)
    made = made.withColumns({"dominant_core": F.col("dominant_cluster") * F.col("z_supported_hot"), "z_unsupported_hot": F.col("raw_hot") - F.col("z_supported_hot")})
    return made.drop("_best", "xy_filled_label")


def average_heat(cells: DataFrame, patches: DataFrame, scores: Sequence[str], radius: Sequence[int], organ: str = "organ") -> DataFrame:
    """cells with, for each score, the mean over the patches whose box covers the cell, 0 where none does and outside the organ.

    patches: case, z, y, x of the centres, and the scores; those that aren't finite are left out.
    """
    names = [f"_{n}_{s}" for s in scores for n in ("sum", "n")]
    rest = [c for c in cells.columns if c not in ("case", *AXES)]
    # Cells and centres meet in a group: a join on cells would move them all.
    both = cells.select("case", *AXES, F.struct(*rest).alias("_rest"), *(F.lit(None).cast("double").alias(f"_{s}") for s in scores))
    both = both.unionByName(patches.select("case", *AXES, F.lit(None).cast(both.schema["_rest"].dataType).alias("_rest"), *(stats.finite(F.col(s)).cast("double").alias(f"_{s}") for s in scores)))
    sums = [f(F.col(f"_{s}")).alias(f"_{n}_{s}") for s in scores for n, f in (("sum", F.sum), ("n", F.count))]
    made = both.groupBy("case", *AXES).agg(F.first("_rest", ignorenulls=True).alias("_rest"), *sums).filter(F.col("_rest").isNotNull())
    made = made.select("case", *AXES, "_rest.*", *names).na.fill(0, names)
    for axis, r in zip(AXES, radius, strict=True):
        made = made.withColumns({c: F.sum(c).over(line(axis).rangeBetween(-r, r)) for c in names})
    mean = lambda s: F.when(F.col(organ) & (F.col(f"_n_{s}") > 0), F.col(f"_sum_{s}") / F.col(f"_n_{s}")).otherwise(0.0)
    return made.withColumns({s: mean(s) for s in scores}).drop(*names)


def largest_component(cells: DataFrame, value: str, threshold: float, spacing: Sequence[float], organ: str = "organ") -> DataFrame:
    """Per case the cells and the volume of the largest component, joined by faces, of cells at or above the threshold."""
    hot = cells.filter(at_least(value, threshold, organ) == 1).select("case", *AXES)
    sizes = components(hot, AXES, full=False).groupBy("case", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("case").agg(F.max("n").alias("largest_hotspot_voxels"))
    made = cells.select("case").distinct().join(sizes, "case", "left").na.fill(0)
    return made.withColumn("largest_hotspot_mm3", F.col("largest_hotspot_voxels") * F.lit(float(np.prod(spacing))))


#: The threshold of summaries, and those at which clusters are ranked.
HEAT_THRESHOLD, CLUSTER_THRESHOLDS = 0.60, (0.50, 0.60, 0.70)
SCORES = ("cs", "non_cs", "pz", "tz")


def case_summary(cells: DataFrame, patches: DataFrame, radius: Sequence[int], spacing: Sequence[float]) -> DataFrame:
    """One wide row a case: patch scores, their maps, raw and smoothed, hot spots, zones and clusters at several thresholds.

    cells: case, z, y, x and organ; patches: case, z, y, x and the four scores. The maps are
    worked out once and kept by case, as every block of the row reads them.
    """
    crossed = kept(by_case(patches.withColumns({"cs_pz": F.col("cs") * F.col("pz"), "cs_tz": F.col("cs") * F.col("tz")})), "patches")
    heat = average_heat(by_case(cells.select("case", *AXES, "organ")), crossed, SCORES, radius)
    for s in SCORES:
        heat = smoothed(heat, s, out=f"smooth_{s}")
    heat = kept(heat, "heat")
    counts = heat.select("case").distinct().join(crossed.groupBy("case").agg(F.count(F.lit(1)).alias("patches")), "case", "left").na.fill(0)
    inside = heat.filter("organ")
    blocks = {"n": counts} | {f"patch_{s}": score_summary(crossed, "case", s, HEAT_THRESHOLD) for s in (*SCORES, "cs_pz", "cs_tz")}
    for s in SCORES:
        blocks[f"heat_{s}"] = score_summary(inside, "case", s, HEAT_THRESHOLD)
        blocks[f"smooth_{s}"] = score_summary(inside, "case", f"smooth_{s}", HEAT_THRESHOLD)
        blocks[f"spot_{s}"] = largest_component(heat, f"smooth_{s}", HEAT_THRESHOLD, spacing)
    for s in ("pz", "tz"):
        blocks[f"continuous_{s}"] = zone_continuity(heat, f"smooth_{s}", HEAT_THRESHOLD, spacing)
    for threshold in CLUSTER_THRESHOLDS:
        blocks[f"cluster_{threshold:.2f}".replace(".", "_")] = dominant_clusters(heat, "smooth_cs", "smooth_pz", "smooth_tz", threshold, spacing)
    made = None
    for name, block in blocks.items():
        # A block is kept, a row a case, so that no task sorts the cells of several blocks at a time.
        one = kept(block.select("case", *(F.col(c).alias(f"{name}_{c}") for c in block.columns if c != "case")), "block")
        made = one if made is None else made.join(one, "case", "left")
    return made
