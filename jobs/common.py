"""What the jobs' command lines share: config files, logs and the session's beginning and end."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def config(name: str, own: str | None = None) -> dict:
    """The job's settings, beside it in ``name``.json, changed by those of an own file; unknown names are an error."""
    settings = json.loads((HERE / f"{name}.json").read_text(encoding="utf-8"))
    changes = json.loads(Path(own).read_text(encoding="utf-8")) if own else {}
    if unknown := sorted(set(changes) - set(settings)):
        raise ValueError(f"unknown settings: {unknown}")
    return settings | changes


def command_line(name: str, about: str, paths: Mapping[str, str], run: Callable[..., dict]) -> None:
    """Parse paths and a config file, open a session, run the job and close the session."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for path, meaning in paths.items():
        parser.add_argument(f"--{path}", required=True, help=meaning)
    parser.add_argument("--config", help=f"JSON file with settings that replace those of {name}.json")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *(getattr(given, p) for p in paths), config(name, given.config))
    finally:
        spark.stop()
