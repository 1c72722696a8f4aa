"""Running sums, ranks and places in groups of any size.

Values are cut into ranges by group and value, so a group's values spread over as many
tasks as they fill. Sums inside a range are windows; the ranges' totals, one row a range
and group, are summed in front of each. No window holds a whole group's values, and rows
that tie are added up before they are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

PART, AHEAD = "_part", "_ahead"


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Whether two tables agree in all these columns, null with null."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """left with right's other columns, where all keys agree, null with null."""
    told = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return left.join(told, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df, kept, with ``_part``: the range of the order that a row falls in. All that read it see the same ranges."""
    return kept(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ranges")


def totals_ahead(ranged: DataFrame, groups: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(groups, part) with each sum over the group's ranges in front, ``{name}_ahead``, and over all of them, ``{name}_all``."""
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*groups, PART).agg(*(c.alias(name) for name, c in sums.items()))
    told = [(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}{AHEAD}"), F.sum(n).over(whole).alias(f"{n}_all")) for n in sums]
    return totals.select(*groups, PART, *(c for pair in told for c in pair))


def running(per: DataFrame, groups: Sequence[str], value: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """per with, for each column, its sum up to and with the row's value, ``{name}_upto``, and over the group, ``{name}_all``.

    per has one row a group and value. Null values come first, or last where they fall.
    """
    by = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    ranged = in_ranges(per, [*groups, by])
    inside = Window.partitionBy(*groups, PART).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in columns})
    made = beside(summed, totals_ahead(ranged, groups, {c: F.sum(c) for c in columns}), [*groups, PART], "inner")
    return made.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"{c}{AHEAD}") for c in columns}).drop(PART, *(f"{c}{AHEAD}" for c in columns))


def rank01(df: DataFrame, value: str, groups: Sequence[str], out: str) -> DataFrame:
    """df with ``out``, the average rank from 0 to 1 inside a group; nulls, and groups of at most one value, are 0.5."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(per, groups, value, ["_n"])
    # The mean place of the rows that tie, from 0.
    mean = F.col("_n_upto") - (F.col("_n") + 1) / F.lit(2.0)
    placed = ranks.select(*groups, value, F.when(F.col("_n_all") > 1, mean / (F.col("_n_all") - 1)).alias(out))
    return beside(df.drop(out), placed, [*groups, value]).withColumn(out, F.coalesce(out, F.lit(0.5)))


def ecdf(reference: DataFrame, values: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """values with the share of the group's reference that is at most each value, kept half a step off 0 and 1.

    A constant reference gives 0.5, and a group without one null.
    """
    both = values.select(*groups, value, F.lit(0).alias("_ref")).unionByName(reference.select(*groups, value, F.lit(1).alias("_ref")))
    per = both.groupBy(*groups, value).agg(F.sum("_ref").alias("_n")).withColumn("_kinds", ((F.col("_n") > 0) & F.col(value).isNotNull()).cast("long"))
    sums = running(per, groups, value, ["_n", "_kinds"])
    n = F.when(F.col("_n_all") > 0, F.col("_n_all").cast("double"))
    half = F.lit(0.5) / n
    share = F.least(F.greatest(F.col("_n_upto") / n, half), 1 - half)
    return beside(values.drop(out), sums.select(*groups, value, F.when(F.col("_kinds_all") == 1, 0.5).otherwise(F.when(n.isNotNull(), share)).alias(out)), [*groups, value])


def numbered(df: DataFrame, order: Sequence[Column | str], out: str, groups: Sequence[str] = ()) -> DataFrame:
    """df with each row's place from 1 in its group; the order should tell rows apart, as equal ones stay in one range."""
    ranged = in_ranges(df, [*groups, *order])
    inside = ranged.withColumn(out, F.row_number().over(Window.partitionBy(*groups, PART).orderBy(*order)))
    ahead = totals_ahead(ranged, groups, {"_n": F.count(F.lit(1))})
    return beside(inside, ahead, [*groups, PART], "inner").withColumn(out, (F.col(out) + F.col(f"_n{AHEAD}")).cast("long")).drop(PART, f"_n{AHEAD}", "_n_all")


def medians(df: DataFrame, groups: Sequence[str], value: str, out: str, accuracy: int = 10_000) -> DataFrame:
    """(groups, out): exact medians of groups of any size, nulls left out.

    An approximate pass gives each group two values with the middle between them; what lies
    below is counted, and only what lies between is ordered, some 0.2% of the rows. Groups
    whose middle the two values miss are worked out whole.
    """
    rows, slack = df.filter(F.col(value).isNotNull()), 10 / accuracy
    ends = F.percentile_approx(value, [0.5 - slack, 0.5 + slack], accuracy)
    told = kept(rows.groupBy(*groups).agg(ends.alias("_e"), F.count(F.lit(1)).alias("_all")).select(*groups, "_all", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi")), "middles")
    met = beside(rows, F.broadcast(told), groups, "inner").filter(F.col(value) <= F.col("_hi"))
    per = met.groupBy(*groups, "_all", F.when(F.col(value) >= F.col("_lo"), F.col(value)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first, second = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    found = per.withColumn("_upto", upto).groupBy(*groups).agg(
        (F.min(F.when(F.col("_upto") >= first, F.col("_v"))) * 0.5 + F.min(F.when(F.col("_upto") >= second, F.col("_v"))) * 0.5).alias(out),
        (F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)) < F.max(first)).alias("_above"), (F.max("_upto") >= F.max(second)).alias("_below"),
    )
    found = kept(found.select(*groups, F.when(F.col("_above") & F.col("_below"), F.col(out)).alias(out)), "medians")
    missed = found.filter(F.col(out).isNull()).select(*groups)
    whole = beside(rows, F.broadcast(missed), groups, "inner").groupBy(*groups).agg(F.median(value).alias(out))
    return found.filter(F.col(out).isNotNull()).unionByName(whole)
