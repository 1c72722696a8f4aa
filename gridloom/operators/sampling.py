"""Samples, splits and folds that depend on keys and seeds alone, the same in every run and engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: Column | str) -> Column:
    """A text that puts keys in an order which looks random and is fixed by the seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k) if isinstance(k, str) else k for k in keys)))


def stable_seed(*parts: Column | str) -> Column:
    """The first eight hexadecimal digits of a key's SHA-1, as a number."""
    text = F.concat_ws("|", *(F.col(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")


def capped(df: DataFrame, groups: Sequence[str], most: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def placed(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """df with each row's place in its group, from 1, as a window over the group would number it.

    ``order`` starts with a ``draw``. Its first three digits cut a group into 4,096 even pieces
    whatever its keys are; windows number rows inside pieces, and the counts of the pieces before
    are added. So few groups still spread over all tasks, and only rows with one key stay together.
    Null groups are groups of their own.
    """
    taken = {c.lower() for c in df.columns}
    piece, ahead, *names = (f"_{n}{'_' * max(map(len, taken))}" for n in ("piece", "ahead", *(f"g{k}" for k in range(len(groups)))))
    first = F.col(order[0]) if isinstance(order[0], str) else order[0]
    cut = df.withColumn(piece, F.substring(first, 1, 3))
    before = Window.partitionBy(*groups).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*groups, piece).agg(F.count(F.lit(1)).alias(ahead)).withColumn(ahead, F.coalesce(F.sum(ahead).over(before), F.lit(0)))
    counts = counts.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), F.col(piece).alias(f"{piece}p"), ahead)
    inside = cut.withColumn(out, F.row_number().over(Window.partitionBy(*groups, piece).orderBy(*order)))
    same = F.col(piece) == F.col(f"{piece}p")
    for g, n in zip(groups, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return inside.join(counts, same).withColumn(out, (F.col(out) + F.col(ahead)).cast("long")).drop(piece, f"{piece}p", ahead, *names)


def balanced(df: DataFrame, label: str, most: int, ratio: float, order: Sequence[Column | str]) -> DataFrame:
    """At most ``most`` rows a class, and no class above ``ratio`` times the smallest; ``order`` starts with a ``draw``."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    least = sizes.agg(F.min("_size").alias("_least"))
    caps = sizes.crossJoin(least).select(label, F.least("_size", F.lit(most), F.floor(F.col("_least") * ratio)).cast("long").alias("_cap"))
    ranked = placed(df, [label], order, "_n")
    return ranked.join(caps, label).filter("_n <= _cap").drop("_n", "_cap")


def folds(df: DataFrame, strata: Sequence[str], k: int, order: Sequence[Column | str], out: str = "fold", pieces: bool = True) -> DataFrame:
    """Stratified folds 0 to k - 1: rows of a stratum are dealt round in an order that starts with a ``draw``.

    Without ``pieces`` one window numbers a stratum: the same folds, for tables of which a task
    fits a fold anyway.
    """
    ranked = placed(df, strata, order, out) if pieces else df.withColumn(out, F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return ranked.withColumn(out, ((F.col(out) - 1) % k).cast("int"))


def nested_folds(df: DataFrame, key: str, strata: Sequence[str], outer: int, inner: int, seed: int) -> DataFrame:
    """(key, strata, outer_fold, inner_fold): each outer fold's training keys, dealt into inner folds with the seed plus the fold's number."""
    dealt = folds(df.select(key, *strata), strata, outer, [draw(seed, key), key], "_own")
    train = dealt.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).filter("outer_fold <> _own").drop("_own")
    # All outer folds are numbered at once, each by its own draw.
    own = F.md5(F.concat_ws("|", (F.col("outer_fold") + seed).cast("string"), F.col(key)))
    return folds(train, ["outer_fold", *strata], inner, [own, key], "inner_fold").select(key, *strata, "inner_fold", "outer_fold")
