"""Connected components of a link table, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, joined, settled


LINKS_A_FILE = 250_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; a component is its smallest node, of whatever type that has an order.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until the
    links no longer change. Each step's links stay in the shared folder, and no
    step has more links than the input, so neither lineage nor data grows. A
    node's smallest neighbour is found by partial sums, and told to the links of
    nodes that hold many of them without moving those links.
    """
    edges = settled(gathered(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()))
    seen = _state(edges)
    # Later steps have no more links than this, so few links are kept in few files.
    files = max(1, min(2 * links.sparkSession.sparkContext.defaultParallelism, (seen[0] or 0) // LINKS_A_FILE + 1))
    least_of = lambda rows: rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_many"))
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both).withColumn("m", F.least("u", "m"))
        large = joined(both.filter("v > u"), least, "u", "_many", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settled(large.coalesce(files))
        least = settled(least_of(large).coalesce(files))
        moved = joined(large, least, "u", "_many", seen[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
