"""Texture queries (G09, G10, G12 to G15, G17) on vectors stacked into 4 x 8 x 8 volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textures
from ..operators.textures import STATISTICS, texture_columns, texture_table, topology_table
from .registry import Tables, query
from .storage import stacks


def masked(t: Tables) -> DataFrame:
    return stacks(t).withColumn("mask", F.transform("v", lambda x: (x > 0).cast("float")))


def family(name: str) -> list[dict]:
    return [s for s in textures.catalogue() if s["family"] == name]


@query("g09_laws_volumes")
def laws_volumes(t: Tables) -> DataFrame:
    return texture_table(masked(t), family("laws"))


@query("g12_gabor")
def gabor(t: Tables) -> DataFrame:
    return texture_table(masked(t), family("gabor"))


@query("g13_haralick")
def haralick(t: Tables) -> DataFrame:
    return texture_table(masked(t), family("haralick"))


@query("g14_texture_catalogue", """with c as (select count(distinct vec_id // 4) n from embeddings)
  select fam, maps::bigint maps, (maps * 4 * n)::bigint as "rows" from (values ('gabor', 160), ('gradient', 13), ('gray', 20), ('haralick', 65), ('laws', 152)) t(fam, maps), c""")
def texture_catalogue(t: Tables) -> DataFrame:
    """What a full run over the cases asks for, by family: its maps, and a row a case, map and statistic."""
    specs = t.spark.createDataFrame([(s["family"], s["name"]) for s in textures.catalogue()], "fam string, name string")
    asked = masked(t).select("case_id").distinct().crossJoin(F.broadcast(specs))
    return asked.groupBy("fam").agg(F.count_distinct("name").alias("maps"), (F.count(F.lit(1)) * len(STATISTICS)).alias("rows"))


@query("g15_topology_pyramid")
def topology_pyramid(t: Tables) -> DataFrame:
    return topology_table(masked(t))


@query("g17_wide_features")
def wide_features(t: Tables) -> DataFrame:
    """Every statistic of every map as one wide row a case."""
    return texture_columns(masked(t))
