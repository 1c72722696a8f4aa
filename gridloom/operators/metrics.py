"""Binary metrics, curves and confusion tables, exact under ties and without gathering scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import rank01, running


def curve_points(df: DataFrame, groups: Sequence[str], y: str, score: str) -> DataFrame:
    """(groups, score, tp, fp, pos, neg): what lies at or above each distinct score, and the totals."""
    per = df.filter(f"{y} is not null and {score} is not null").groupBy(*groups, F.col(score).alias("score"))
    per = per.agg(F.sum(y).cast("double").alias("_p"), F.sum(1 - F.col(y)).cast("double").alias("_n"))
    names = {"_p_upto": "tp", "_n_upto": "fp", "_p_all": "pos", "_n_all": "neg"}
    return running(per, groups, "score", ["_p", "_n"], descending=True).withColumnsRenamed(names)


def auc_ap(df: DataFrame, groups: Sequence[str], y: str, score: str) -> DataFrame:
    """(groups, auc, ap); null where a class is missing. Ties count half; AP sums recall steps times precision."""
    p = curve_points(df, groups, y, score)
    auc = F.sum(F.col("_p") * (F.col("neg") - F.col("fp")) + F.col("_p") * F.col("_n") / 2) / F.max(F.col("pos") * F.col("neg"))
    ap = F.sum(F.col("_p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = p.filter("pos > 0 and neg > 0").groupBy(*groups).agg(auc.alias("auc"), ap.alias("ap"))
    return p.select(*groups).distinct().join(both, list(groups), "left")


def binary_metrics(df: DataFrame, groups: Sequence[str], y: str, score: str, pred: str) -> DataFrame:
    """n, AUC, AP, balanced accuracy, F1, accuracy, sensitivity and specificity of each group.

    Where a class is missing, its sensitivity or specificity is null, and balanced accuracy is the other class's.
    """
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b)).cast("double")
    c = df.filter(f"{y} is not null").groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sens, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    made = c.select(
        *groups, "n", F.coalesce((sens + spec) / 2, sens, spec).alias("balanced_acc"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        ratio(F.col("tp") + F.col("tn"), F.col("n").cast("double")).alias("acc"), sens.alias("sensitivity"), spec.alias("specificity"),
    )
    return made.join(auc_ap(df, groups, y, score), list(groups))


def confusion(df: DataFrame, groups: Sequence[str], y: str, pred: str, labels: Sequence) -> DataFrame:
    """Every pair of labels with its count and its share of the row; a row without cases has shares of 0."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"y {df.schema[y].dataType.simpleString()}, p {df.schema[y].dataType.simpleString()}")
    counted = df.groupBy(*groups, F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    full = df.select(*groups).distinct().crossJoin(F.broadcast(grid)) if groups else grid
    filled = full.join(counted, [*groups, "y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    row = F.sum("n").over(Window.partitionBy(*groups, "y"))
    return filled.withColumn("share", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def late_fusion(a: DataFrame, b: DataFrame, keys: Sequence[str], groups: Sequence[str], alpha: float = 0.5) -> DataFrame:
    """Two aligned score tables with ``a_norm``, ``b_norm`` (average ranks from 0 to 1 inside groups) and their blend ``score``."""
    both = a.join(b, list(keys))
    normed = rank01(rank01(both, "a_score", groups, "a_norm"), "b_score", groups, "b_norm")
    return normed.withColumn("score", alpha * F.col("a_norm") + (1 - alpha) * F.col("b_norm"))
