"""Append sinks and stages that can be stopped and started again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def done_keys(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Keys with any value published."""
    return table.filter(F.coalesce(*(F.col(c).cast("string") for c in values)).isNotNull()).select(key).distinct()


#: Folders that published keys are dealt into.
BUCKETS = 16


def append_missing(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Append the rows whose key the sink doesn't hold yet; of rows with one key, one.

    The sink is partitioned by a hash of the key, and only the folders that the rows' keys
    fall in are listed and read, so a small batch doesn't meet all that was published.
    """
    spark = rows.sparkSession
    placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]
    missing = placed.dropDuplicates([key]).join(held_keys(spark, path, rows.select(key).schema, touched), key, "left_anti")
    missing.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


BUCKET = "_bucket_"


def held_keys(spark: SparkSession, path: str, schema: T.StructType, touched: Sequence[int]) -> DataFrame:
    """The keys in some of the sink's folders; those that aren't there have none."""
    folders = [f"{path}/{BUCKET}={bucket}" for bucket in sorted(touched)]
    try:
        return spark.read.schema(schema).parquet(*folders)
    except AnalysisException:
        parts = [published(spark, folder, schema) for folder in folders]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def resume_stream(source: DataFrame, path: str, checkpoint: str, key: str, buckets: int = BUCKETS) -> None:
    """Run a streaming table up to its present end, each batch appended once: keys that the sink holds, from an earlier try or run, are skipped."""
    query = source.writeStream.foreachBatch(lambda batch, _: append_missing(batch, path, key, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


@dataclass
class Stage:
    """A piece of a run: what it needs, whether its results are valid, and how to make them."""

    name: str
    build: Callable[[], None]
    valid: Callable[[], bool]
    needs: Sequence[str] = ()


@dataclass
class Run:
    """Stages in order. One runs if its results aren't valid, or if one that it needs has just run."""

    stages: Sequence[Stage]
    log: list[tuple[str, str]] = field(default_factory=list)

    def __call__(self, wanted: Sequence[str] | None = None) -> list[tuple[str, str]]:
        by = {s.name: s for s in self.stages}
        asked: set[str] = set()

        def pull(name: str) -> None:
            if name not in asked:
                asked.add(name)
                for n in by[name].needs:
                    pull(n)

        for name in wanted or by:
            pull(name)
        ran: set[str] = set()
        for stage in self.stages:
            if stage.name in asked:
                if set(stage.needs) & ran or not stage.valid():
                    stage.build()
                    if not stage.valid():
                        raise RuntimeError(f"{stage.name}: results aren't valid after a run")
                    ran.add(stage.name)
                    self.log.append((stage.name, "run"))
                else:
                    self.log.append((stage.name, "skipped"))
        return self.log


def complete(table: DataFrame, expected: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a table holds exactly the expected keys."""
    a, b = table.select(*keys).distinct(), expected.select(*keys).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def outcomes(table: DataFrame, status: str, reason: str) -> DataFrame:
    """Rows by status and by each of their reasons."""
    return table.withColumn("_r", F.explode_outer(reason)).groupBy(status, F.col("_r").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
