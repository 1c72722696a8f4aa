"""Feature book of a cohort of texts: a case's features, labels and folds, scaled by each outer fold's training rows alone.

    python jobs/feature_book.py --documents DIR --labels DIR --output DIR [--config FILE]

Reads a table of texts and a table of labels, and writes three Parquet tables below the
output folder:

``cases``, partitioned by ``fold``: one row a case with its raw features and label.
Labelled cases are dealt into outer folds within their class; the others have fold -1.

``scales``, partitioned by ``outer_fold``: one row a feature with the number, mean and
deviation of the fold's training rows, and how far apart their classes are (standardised
mean difference). It holds all that the fold's preparation has learned.

``book``, partitioned by ``outer_fold`` and ``role``: every case once for each outer
fold, as ``train``, as ``test`` (the fold that holds it out) or as ``apply`` (without a
label), its features standardised by the fold's scales.

Ids that differ only in case or marks, but are in different folds, may be one case in
training and test; they are counted and logged.

Features are worked out where texts are read, so texts are never shuffled; folds and
statistics are aggregates and windows over narrow rows. All tables are replaced as a
whole, and depend on input and settings alone, so a rerun gives the same rows; a run that
stopped is mended by the next.

Cases: ids are trimmed and spellings of nothing are left out; of rows with one id that
with the smallest features stays, of an id's labels the larger; labels are read in all
accepted spellings, others count as none; a null text has null features, and a missing or
constant feature is 0 after scaling, the training mean. Labels of unknown ids are left out.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridloom.functions.clean import finite, flag, key, loose_key
from gridloom.functions.stats import smd
from gridloom.operators.relational import first_rows
from gridloom.operators.sampling import draw, folds
from jobs import common

LOG = logging.getLogger("feature_book")
NAME = "feature_book"
WORD = r"[^\x20\x09-\x0D]+"


def text_features(text: Column) -> dict[str, Column]:
    """Size, word, line and character-class measures of a text, by built-in expressions."""
    chars, words = F.char_length(text), F.regexp_count(text, F.lit(WORD))
    blanks = F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))
    share = lambda pattern: F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), chars)
    different = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "log_words": F.log1p(words.cast("double")),
        "bytes_per_char": F.try_divide(F.octet_length(text).cast("double"), chars),
        "word_chars": F.try_divide((chars - blanks).cast("double"), words),
        "line_words": words / (F.regexp_count(text, F.lit(r"\n")) + 1),
        "distinct_words": F.try_divide(different.cast("double"), words),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "marks": share(r"[!-/:-@\[-`{-~]"),
    }


FEATURES = ("log_chars", "log_words", "bytes_per_char", "word_chars", "line_words", "distinct_words", "digits", "capitals", "marks")


def cases(documents: DataFrame, labels: DataFrame, settings: dict) -> DataFrame:
    """(case_id, label, fold, features) of every document."""
    made = text_features(F.col(settings["text"]))
    features = documents.select(key(F.col(settings["id"])).alias("case_id"), *(finite(made[f]).alias(f) for f in FEATURES))
    once = first_rows(features.filter("case_id is not null"), ["case_id"], [F.col(f).asc_nulls_last() for f in FEATURES])
    told = labels.select(key(F.col(settings["id"])).alias("case_id"), flag(F.col(settings["label"])).alias("label"))
    told = told.filter("case_id is not null").groupBy("case_id").agg(F.max("label").alias("label"))
    # Folds are dealt from ids and labels alone, so that texts are read once.
    ids = documents.select(key(F.col(settings["id"])).alias("case_id"))
    known = told.filter("label is not null").join(ids, "case_id", "left_semi")
    dealt = folds(known, ["label"], settings["folds"], [draw(settings["seed"], "case_id"), "case_id"]).select("case_id", "label", "fold")
    return once.join(dealt, "case_id", "left").select("case_id", "label", F.coalesce("fold", F.lit(-1)).alias("fold"), *FEATURES)


def placed(rows: DataFrame, settings: dict) -> DataFrame:
    """Every case once for each outer fold, with its role there."""
    outer = rows.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(settings["folds"] - 1))))
    return outer.withColumn("role", F.when(F.col("fold") < 0, "apply").when(F.col("fold") == F.col("outer_fold"), "test").otherwise("train"))


def scales(rows: DataFrame, settings: dict) -> DataFrame:
    """(feature, n, mean, std, difference, outer_fold) of each outer fold's training rows; partial sums leave the scan tasks."""
    train = placed(rows, settings).filter("role = 'train'").groupBy("outer_fold")
    told = lambda f: F.struct(F.lit(f).alias("feature"), F.count(f).alias("n"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), smd(F.col(f), F.col("label")).alias("difference"))
    made = train.agg(*(told(f).alias(f) for f in FEATURES)).select("outer_fold", F.explode(F.array(*FEATURES)).alias("s"))
    return made.select("s.*", "outer_fold")


def book(rows: DataFrame, fitted: DataFrame, settings: dict) -> DataFrame:
    """Every case of ``cases`` once for each outer fold, scaled by the fold's ``scales``."""
    # One row an outer fold, however many cases there are.
    scale = fitted.groupBy("outer_fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_scale"))
    scaled = placed(rows, settings).join(F.broadcast(scale), "outer_fold", "left")
    of = lambda f: F.col("_scale")[f]
    z = lambda f: F.when(of(f)["std"] > 0, (F.col(f) - of(f)["mean"]) / of(f)["std"])
    return scaled.select("case_id", "label", *(F.round(F.coalesce(z(f), F.lit(0.0)), settings["places"]).alias(f) for f in FEATURES), "outer_fold", "role")


def leaks(rows: DataFrame) -> int:
    """How many ids, without case and marks, stand in more than one fold."""
    known = rows.filter("fold >= 0").groupBy(loose_key(F.col("case_id")).alias("key")).agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    return known.filter("lo <> hi").count()


def write(df: DataFrame, path: str, *partitions: str) -> int:
    """Replace a partitioned table, in files of an even size; its number of rows."""
    df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partitions).parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).count()
    LOG.info("wrote %d rows to %s", rows, path)
    return rows


CASES = "case_id string, label int, " + ", ".join(f"{f} double" for f in FEATURES)


SCHEMAS = {
    "cases": f"{CASES}, fold int",
    "scales": "feature string, n long, mean double, std double, difference double, outer_fold int",
    "book": f"{CASES}, outer_fold int, role string",
}


def read(spark: SparkSession, output: str, name: str) -> DataFrame:
    """``cases``, ``scales`` or ``book`` as it stands."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{output}/{name}")


def run(spark: SparkSession, documents: str, labels: str, output: str, settings: dict | None = None) -> dict:
    """Read both tables, write the three below output; the numbers of rows read and written, and of leaks."""
    settings = settings or common.config(NAME)
    texts, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    counts = {"documents": texts.count(), "labels": marks.count()}
    LOG.info("read %d rows of %s and %d rows of %s", counts["documents"], documents, counts["labels"], labels)
    counts["cases"] = write(cases(texts, marks, settings), f"{output}/cases", "fold")
    rows = read(spark, output, "cases")
    counts["leaks"] = leaks(rows)
    if counts["leaks"]:
        LOG.warning("%d ids differ only in case or marks from one in another fold", counts["leaks"])
    counts["scales"] = write(scales(rows, settings), f"{output}/scales", "outer_fold")
    counts["book"] = write(book(rows, read(spark, output, "scales"), settings), f"{output}/book", "outer_fold", "role")
    return counts


if __name__ == "__main__":
    common.command_line(NAME, "Feature book of a cohort of texts.", {"documents": "table of texts", "labels": "table of labels", "output": "folder for cases, scales and book"}, run)
