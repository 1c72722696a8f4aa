"""Range joins as equality joins on buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(centers: DataFrame, points: DataFrame, keys: Sequence[str], middle: str, at: str, radius: int) -> DataFrame:
    """Every center with the points of its key at most ``radius`` away.

    Points are put into buckets of two radii; a center meets the two buckets
    that its window can touch, so each pair is found once and no key makes a
    product of all its rows.
    """
    width = 2 * radius + 1
    bucket = lambda c: F.floor(c / width).cast("long")
    near = centers.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col(middle) - radius), bucket(F.col(middle) + radius)))))
    return near.join(points.withColumn("_bucket", bucket(F.col(at))), [*keys, "_bucket"]).filter(F.abs(F.col(at) - F.col(middle)) <= radius).drop("_bucket")
