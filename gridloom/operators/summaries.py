"""Summaries of scores by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def score_summary(df: DataFrame, group: str, score: str, cut: float) -> DataFrame:
    """23 numbers on each group's finite scores; of its best scores, ranks are counted by rows. A group without finite scores has nulls."""
    v = F.col(score).cast("double")
    x = df.select(group, F.when(F.abs(v) < float("inf"), v).alias("x"))
    ranked = x.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last("x")))).withColumn("_n", F.count("x").over(Window.partitionBy(group)))
    best = lambda n: F.avg(F.when(F.col("_r") <= n, F.col("x")))
    some = lambda c: F.when(F.count("x") > 0, c)
    ge = {"0_50": 0.5, "0_60": 0.6, "0_70": 0.7, "0_80": 0.8, "threshold": cut}
    return ranked.groupBy(group).agg(
        some(F.count("x")).alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"), *(stats.quantile(F.col("x"), p).alias(n) for n, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))),
        *(best(n).alias(f"top{n}_mean") for n in (5, 10, 20)), *(best(F.ceil(F.col("_n") * F.lit(s))).alias(f"top{k}pct_mean") for k, s in ((1, 0.01), (5, 0.05))),
        *(some(F.count_if(F.col("x") >= v)).alias(f"count_ge_{k}") for k, v in ge.items()), *(F.avg((F.col("x") >= v).cast("double")).alias(f"frac_ge_{k}") for k, v in ge.items()),
    )
