"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "gridloom", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster, use the one that is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spread(spark: SparkSession) -> int:
    """Tasks for rows that are few bytes and long work, which Spark would merge into few tasks by their size: three a core, or more where shuffles have more."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, or, on one machine, below an own folder where that is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(folder)
        folder = f"file://{folder}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder and read again: computed once, the same rows for all that read it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, written once in the shared folder in ``spread`` buckets by a key, and read again: what groups, joins or windows it by the key shuffles nothing.

    Rows that are dealt by the key already, in as many partitions, stay in their tasks. The
    table has a name only until it is read; its files stay.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    table = f"gridloom_{uuid.uuid4().hex}"
    df.write.bucketBy(spread(spark), key).option("path", path).saveAsTable(table)
    made = spark.table(table)
    spark.sql(f"drop table {table}")
    return made
