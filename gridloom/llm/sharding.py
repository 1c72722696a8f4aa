"""Contiguous, byte-balanced shards by global prefix sums.

Rows are range-partitioned by an order key, each range partition is summed, the
few partition totals are summed up in front of each partition, and a window
inside a partition adds the rest. A row goes to the shard in which the middle
of its bytes falls when the whole corpus is cut at equal targets. Only the key,
the size and a checksum are shuffled; texts stay where they are.

Cases: a null text has no bytes; rows with the same key follow each other by
size and checksum, and rows equal in all three are interchangeable; a null key
comes first; an empty table gives no rows; with fewer rows than shards some
shards are empty; one row larger than a target keeps its shard to itself; other
columns pass through, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, unused


def prefix_sums(rows: DataFrame, order: list[str], size: str, total_as: str = "_before", index_as: str = "_index") -> DataFrame:
    """rows with the sum of ``size`` and the number of rows before each row in the global order.

    The order's last key is the row's place in its input, so that any number of
    equal keys still spreads over the ranges. The ranges are kept in the shared
    folder: the totals and the rows must see the same ranges.
    """
    at, part, summed, counted = (unused(rows, name) for name in ("_place", "_range", "_sum", "_rows"))
    keys = [*order, at]
    ranged = settled(rows.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(part).agg(F.sum(size).alias(summed), F.count(F.lit(1)).alias(counted))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in (summed, counted)))
    inside = Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(offsets, part)
        .withColumn(total_as, F.col(summed) + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn(index_as, F.col(counted) + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))
        .drop(at, part, summed, counted)
    )


def shard_by_bytes(rows: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """rows with ``shard`` (from 0) and ``slot`` (the row's place in its shard, from 0)."""
    before, index, every, first = (unused(rows, name) for name in ("_before", "_index", "_all", "_first"))
    summed = settled(prefix_sums(rows, order, size, before, index))
    whole = summed.agg(F.sum(size).alias(every))
    middle = (F.col(before) * 2 + F.col(size)).cast("decimal(38,0)") * shards
    cut = F.when(F.col(every) > 0, F.floor(middle / (F.col(every) * 2))).otherwise(0)
    dealt = summed.crossJoin(F.broadcast(whole)).withColumn("shard", F.least(F.lit(shards - 1), cut.cast("int")))
    # One row a shard, at most `shards` of them: small enough to send to every task.
    heads = dealt.groupBy("shard").agg(F.min(index).alias(first))
    return dealt.join(F.broadcast(heads), "shard").withColumn("slot", F.col(index) - F.col(first)).drop(first, every, before, index)
