"""Stored models: a table of numbers beside a record of how they were made."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def folder_of(path: str, settings: str) -> str:
    """Each settings' own folder, so that no models are stored where others' record is."""
    return f"{path}/made-{hashlib.sha1(settings.encode()).hexdigest()}"


def record_of(spark: SparkSession, folder: str) -> str | None:
    try:
        lines = spark.read.text(f"{folder}/record").collect()
    except AnalysisException:
        return None
    return lines[0]["value"] if lines else None


def stored_or_fitted(spark: SparkSession, path: str, made_with: Mapping, fit: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(models, whether they were there): stored models are used again only if they were made with the very same settings.

    Models lie in a folder of their settings, and the record is written last: a run that
    stops leaves models without a record, which the next run of the same settings replaces,
    and no other settings' models are touched.
    """
    settings = json.dumps(dict(made_with), sort_keys=True)
    folder = folder_of(path, settings)
    if record_of(spark, folder) == settings:
        return spark.read.parquet(f"{folder}/models"), True
    fit().write.mode("overwrite").parquet(f"{folder}/models")
    spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/record")
    return spark.read.parquet(f"{folder}/models"), False
