"""Score ledger: scores arrive in files, and each day's summary by case and channel is kept current.

    python jobs/score_ledger.py --scores DIR --output DIR [--config FILE]

A stream takes the Parquet files that no earlier run has taken (``availableNow``) and ends.
Below the output folder it keeps

``detail``, partitioned by ``day`` and ``batch``: the scores as they came;
``ledger``, partitioned by ``day``: one row a case and channel with the number of scores,
their mean, deviation, extremes and the mean of the best;
``rejected``, partitioned by ``batch``: rows without an id, a time or a case, with the reasons;
``progress``: the stream's checkpoint, which belongs to these tables.

A batch replaces its own partitions of ``detail`` and ``rejected``, then the ledger's
partitions of the days that it touched, worked out anew from these days' details. So a
batch that runs again after a failure changes nothing, late scores reopen their day, and
the work of a run grows with its days and not with the ledger.

Cases: a score is its id and its day: of rows that repeat one the earliest batch's stays,
in a batch the smallest in time, case, channel and score; null and non-finite scores are
counted and otherwise left out; a null channel is a channel; days follow the session's time
zone; without new files nothing is written.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Sequence
from datetime import date
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridloom.functions.clean import finite
from gridloom.operators.ranking import best_per_group
from gridloom.operators.relational import first_rows
from jobs import common

LOG = logging.getLogger("score_ledger")
NAME = "score_ledger"
GROUPS = ("day", "case_id", "channel")


def named(rows: DataFrame, settings: dict) -> DataFrame:
    """(score_id, ts, case_id, channel, score, day, reasons); no reasons for rows that count."""
    source = {"score_id": "id", "ts": "time", "case_id": "case", "channel": "channel", "score": "score"}
    picked = rows.select(*(F.col(settings[s]).alias(name) for name, s in source.items()))
    lacks = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("score_id", "ts", "case_id")]
    return picked.withColumn("score", F.col("score").cast("double")).withColumn("day", F.to_date("ts")).withColumn("reasons", F.array_join(F.array_compact(F.array(*lacks)), ", "))


def summary(detail: DataFrame, settings: dict) -> DataFrame:
    """The ledger's rows of the days in detail."""
    once = first_rows(detail, ["day", "score_id"], [F.col("batch"), *(F.col(c).asc_nulls_last() for c in ("ts", "case_id", "channel", "score"))])
    scores = once.withColumn("score", finite(F.col("score")))
    rounded = lambda c: F.round(c, settings["places"])
    whole = scores.groupBy(*GROUPS).agg(
        F.count(F.lit(1)).alias("taken"), F.count("score").alias("scored"), rounded(F.avg("score")).alias("mean"), rounded(F.stddev_pop("score")).alias("std"),
        rounded(F.min("score")).alias("least"), rounded(F.max("score")).alias("most"),
    )
    # The best are cut before they are shuffled, so a group of any size sends a few rows a task.
    best = best_per_group(scores.filter("score is not null"), GROUPS, [F.desc("score"), F.col("score_id")], settings["best"])
    best = best.groupBy(*GROUPS).agg(rounded(F.avg("score")).alias("best_mean"))
    same = [whole[c].eqNullSafe(best[c]) for c in GROUPS]
    return whole.join(best, same[0] & same[1] & same[2], "left").select(*(whole[c] for c in whole.columns), "best_mean")


def schemas(source: T.StructType, settings: dict) -> dict[str, T.StructType]:
    """What the output tables hold, by the types of the source."""
    kind = lambda s: source[settings[s]].dataType
    row = T.StructType().add("score_id", kind("id")).add("ts", kind("time")).add("case_id", kind("case")).add("channel", kind("channel")).add("score", "double")
    rejected = T.StructType([*row.fields]).add("reasons", "string").add("batch", "long")
    detail = T.StructType([*row.fields]).add("day", "date").add("batch", "long")
    ledger = T.StructType().add("case_id", kind("case")).add("channel", kind("channel")).add("taken", "long").add("scored", "long")
    for c in ("mean", "std", "least", "most", "best_mean"):
        ledger = ledger.add(c, "double")
    return {"detail": detail, "ledger": ledger.add("day", "date"), "rejected": rejected}


def write(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace those partitions of a table that df has rows for."""
    dealt = df.hint("rebalance", *partitions)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def take(batch: DataFrame, number: int, output: str, kinds: dict[str, T.StructType], settings: dict) -> dict:
    """Put one batch into the tables; its days, and its numbers of rows read, rejected and written."""
    spark = batch.sparkSession
    rows = named(batch, settings).withColumn("batch", F.lit(number).cast("long"))
    days = sorted(r["day"] for r in rows.filter("reasons = ''").select("day").distinct().collect())
    write(rows.filter("reasons <> ''").drop("day"), f"{output}/rejected", "batch")
    counts = {"batch": number, "days": len(days), "rejected": table(spark, f"{output}/rejected", kinds["rejected"], f"batch={number}").count()}
    if days:
        write(rows.filter("reasons = ''").drop("reasons"), f"{output}/detail", "day", "batch")
        # The touched days alone are listed and read.
        detail = days_of(spark, f"{output}/detail", kinds["detail"], days)
        write(summary(detail, settings), f"{output}/ledger", "day")
        counts["taken"] = detail.filter(F.col("batch") == number).count()
        counts["written"] = days_of(spark, f"{output}/ledger", kinds["ledger"], days).count()
    LOG.info("batch %d: took %d rows of %d days, rejected %d, wrote %d rows of the ledger", number, counts.get("taken", 0), len(days), counts["rejected"], counts.get("written", 0))
    return counts


def days_of(spark: SparkSession, path: str, kind: T.StructType, days: Sequence[date]) -> DataFrame:
    """Some days of a table, read by their folders, so that no others are listed."""
    return spark.read.schema(kind).option("basePath", path).parquet(*(f"{path}/day={d}" for d in days))


def table(spark: SparkSession, path: str, kind: T.StructType, folder: str = "") -> DataFrame:
    """A table or one of its folders, with partition columns; without rows where it isn't there."""
    try:
        return spark.read.schema(kind).option("basePath", path).parquet(f"{path}/{folder}")
    except AnalysisException:
        return spark.createDataFrame([], kind)


def read(spark: SparkSession, scores: str, output: str, settings: dict | None = None) -> dict[str, DataFrame]:
    """The tables as they stand; without rows where nothing was written yet."""
    kinds = schemas(spark.read.parquet(scores).schema, settings or common.config(NAME))
    return {name: table(spark, f"{output}/{name}", kind) for name, kind in kinds.items()}


def run(spark: SparkSession, scores: str, output: str, settings: dict | None = None) -> list[dict]:
    """Take what is new below scores into the tables below output; the counts of each batch."""
    settings = settings or common.config(NAME)
    source = spark.read.parquet(scores).schema
    kinds, done = schemas(source, settings), []
    stream = spark.readStream.schema(source).option("maxFilesPerTrigger", settings["files_a_batch"]).parquet(scores)
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: done.append(take(batch, number, output, kinds, settings)))
        .option("checkpointLocation", f"{output}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    LOG.info("read %d rows below %s in %d batches", sum(d.get("taken", 0) + d["rejected"] for d in done), scores, len(done))
    return done


if __name__ == "__main__":
    common.command_line(NAME, "Daily score summaries kept current.", {"scores": "folder, or pattern, of Parquet files with scores", "output": "folder for the tables and the checkpoint"}, run)
