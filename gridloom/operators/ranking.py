"""Best rows, window searches and diversity-capped choices in groups that are bounded by nature; ``ordered`` has ranks in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_window(df: DataFrame, group: str, position: str, value: str, length: int, near: str) -> DataFrame:
    """Each group's stretch of ``length`` positions with the largest sum: (group, start, total).

    Of equal sums that whose middle is nearest to ``near``, then the first. Groups shorter than
    the length start at their first position.
    """
    order = Window.partitionBy(group).orderBy(position)
    summed = df.withColumn("_total", F.sum(value).over(order.rowsBetween(0, length - 1))).withColumn("_left", F.count(F.lit(1)).over(order.rowsBetween(0, length - 1)))
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    open_ = summed.withColumn("_n", size).filter((F.col("_left") == length) | ((F.col("_n") < length) & (F.col("_left") == F.col("_n"))))
    off = F.abs(F.col(position) + F.lit((length - 1) / 2) - F.col(near))
    ranked = open_.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_total"), off, position)))
    return ranked.filter("_r = 1").select(group, F.col(position).alias("start"), F.col("_total").alias("total"))


def padded_positions(count: int, near: int, need: int) -> list[int]:
    """Positions 0 to count - 1, the ends repeated until there are ``need``; an odd one is put in front where the peak lies in the first half."""
    extra = max(0, need - count)
    front = extra // 2 + (1 if extra % 2 and near < count // 2 else 0)
    return [0] * front + list(range(count)) + [count - 1] * (extra - front)


def best_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def penalised(df: DataFrame, groups: Sequence[str], mean: str, spread: str, penalty: float, out: str) -> DataFrame:
    """df with ``out``, the mean less a share of the spread; an unknown spread is the group's largest, or 0 where none is known, and an unknown mean comes last.

    A group is a fold's candidates, of which there are few.
    """
    largest = F.max(spread).over(Window.partitionBy(*groups))
    return df.withColumn(out, F.coalesce(mean, F.lit(float("-inf"))) - penalty * F.coalesce(spread, largest, F.lit(0.0)))


def every_nth(df: DataFrame, group: str, order: Sequence[Column | str], step: int) -> DataFrame:
    """Rows 1, step + 1, 2 step + 1, ... of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter((F.col("_r") - 1) % step == 0).drop("_r")


def first_cases(df: DataFrame, case: str, position: str, n: int) -> DataFrame:
    """All rows of the n cases that are met first."""
    met = df.groupBy(case).agg(F.min(position).alias("_at")).orderBy("_at", case).limit(n)
    return df.join(met.select(case), case, "left_semi")


def diverse_top(df: DataFrame, groups: Sequence[str], order: Sequence[str], ascending: Sequence[bool], k: int, caps: dict[str, int]) -> DataFrame:
    """The k best rows a group, none of the capped columns' values more often than its cap; what is short is filled from the rest.

    No cap, or one, is a plain ranking. Under several the choice is sequential, and
    each group, a fold's candidates, is worked on as a whole.
    """
    active = {c: n for c, n in caps.items() if n > 0}
    keys = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(order, ascending, strict=True)]
    if len(active) <= 1:
        over = df.withColumn("_over", F.lit(False))
        for c, n in active.items():
            over = df.withColumn("_over", F.row_number().over(Window.partitionBy(*groups, c).orderBy(*keys)) > n)
        ranked = over.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(*groups).orderBy("_over", *keys)))
        return ranked.filter(F.col("candidate_rank") <= k).drop("_over")
    schema = df.withColumn("candidate_rank", F.lit(1)).schema

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), ascending=list(ascending), kind="stable", na_position="last").reset_index(drop=True)
        used: dict[tuple[str, object], int] = {}
        chosen, passed = [], []
        for i, marks in enumerate(zip(*(zip([c] * len(rows), rows[c], strict=True) for c in active), strict=True)):
            if len(chosen) == k:
                break
            if all(used.get(m, 0) < active[m[0]] for m in marks):
                chosen.append(i)
                for m in marks:
                    used[m] = used.get(m, 0) + 1
            else:
                passed.append(i)
        chosen += passed[: k - len(chosen)]
        return rows.loc[chosen].assign(candidate_rank=range(1, len(chosen) + 1))

    return df.groupBy(*groups).applyInPandas(pick, schema)
