"""What the corpus operators share: table access, shared folders, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])

#: A word of the corpus contracts: a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch at most, so that very long texts or files don't meet in one.
BATCH_BYTES = 1 << 20


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores as make it none of the columns'."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ready(spark: SparkSession) -> SparkSession:
    """Make Python workers find this package, and bound the bytes of an Arrow batch; its rows stay as they are set."""
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO_ROOT, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine, an own one where that is unset."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="gridloom-")
    sc.setCheckpointDir(own)
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def gathered(df: DataFrame) -> DataFrame:
    """df in as few partitions as its size asks for, a partition a core at most: for tables far smaller than the corpus.

    The rows are dealt anew, so what computes them keeps its own partitions and their
    memory; merging those partitions into few tasks would add up what their sorts hold.
    """
    return df.hint("rebalance").coalesce(df.sparkSession.sparkContext.defaultParallelism)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: A key is heavy if it holds more than this part of all rows, so there are at most so many heavy keys.
HEAVY = 1000


def joined(left: DataFrame, right: DataFrame, on: str, many: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and tells in ``many`` how many of left's ``total`` rows have it; ``many`` is dropped.

    Heavy keys are fewer than ``HEAVY``, whatever the data, so their rows of right go to
    every task and left's stay where they are; only the others are shuffled. Both sides
    are read more than once, so they should be kept tables or cheap scans. Rows of left
    without a key are left out.
    """
    limit = max(1, total // HEAVY)
    heavy = right.filter(F.col(many) > limit).drop(many)
    keys = [r[0] for r in heavy.select(on).collect()]
    if not keys:
        return left.filter(F.col(on).isNotNull()).join(right.drop(many), on, how)
    hot = left.filter(F.col(on).isin(keys)).join(F.broadcast(heavy), on)
    return hot.unionByName(left.filter(~F.col(on).isin(keys)).join(right.filter(F.col(many) <= limit).drop(many), on, how))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as compressed Parquet in the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
