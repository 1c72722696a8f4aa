"""Joins, set operations, checks and orderings with the reference's rules about names, keys and order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Violation(ValueError):
    """A table breaks a rule; the message holds up to eight examples."""


def examples(df: DataFrame, columns: Sequence[str]) -> list[tuple]:
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).limit(8).collect()]


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, or Violation if a key repeats."""
    if found := examples(df.groupBy(*keys).count().filter("count > 1"), keys):
        raise Violation(f"repeated keys: {found}")
    return df


def missing_keys(expected: DataFrame, got: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(got.select(*keys).distinct(), list(keys), "left_anti")


def require_coverage(expected: DataFrame, got: DataFrame, keys: Sequence[str]) -> DataFrame:
    """got, or Violation if a key is missing or repeats."""
    if found := examples(missing_keys(expected, got, keys), keys):
        raise Violation(f"missing keys: {found}")
    return require_unique(got, keys)


def left_wins(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """An equality join in which the left side keeps columns that both have."""
    return left.join(right.drop(*(set(left.columns) & set(right.columns) - set(keys))), list(keys), how)


def inner_all(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner joins of several blocks, the first table's columns winning over later ones."""
    return reduce(lambda a, b: left_wins(a, b, keys, "inner"), tables)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join of tables with the very same unique keys, or Violation."""
    require_unique(left, keys)
    require_unique(right, keys)
    unmatched = missing_keys(left, right, keys).unionByName(missing_keys(right, left, keys))
    if found := examples(unmatched, keys):
        raise Violation(f"unmatched keys: {found}")
    joined = left_wins(left, right, keys, "inner")
    if joined.isEmpty():
        raise Violation("no rows")
    return joined


def in_order_of(df: DataFrame, reference: DataFrame, position: str, keys: Sequence[str]) -> DataFrame:
    """df sorted by where its key first stands in the reference; keys that aren't there come last."""
    places = reference.groupBy(*keys).agg(F.min(position).alias("_place"))
    return df.join(places, list(keys), "left").orderBy(F.col("_place").asc_nulls_last(), *keys).drop("_place")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Each key's first row in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new, and what it doesn't replace of old."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def grid(*tables: DataFrame) -> DataFrame:
    """Every combination of small parameter tables."""
    return reduce(lambda a, b: a.crossJoin(b), tables)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def long_form(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row a key and column."""
    return df.unpivot(list(keys), list(values), name, value)


def column_pairs(df: DataFrame, keys: Sequence[str], left: Sequence[str], right: Sequence[str], how: str, names: Sequence[str]) -> DataFrame:
    """Products ("hada") or differences ("diff") of paired columns."""
    op = (lambda a, b: F.col(a) * F.col(b)) if how == "hada" else (lambda a, b: F.col(a) - F.col(b))
    return df.select(*keys, *(op(a, b).alias(n) for a, b, n in zip(left, right, names, strict=True)))


def without_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """df without columns that hold no value, found in one pass."""
    others = [c for c in df.columns if c not in keep]
    counted = df.agg(*(F.count(c).alias(c) for c in others)).first().asDict()
    return df.drop(*(c for c in others if not counted[c]))


def top(df: DataFrame, n: int, descending: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """The first n rows: measures falling, nulls last, then keys rising."""
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in descending), *ties).limit(n)
