"""Runs made of learning operators: out-of-fold scores, deployable models, their use on a new cohort, and stacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import fits
from . import learning as L
from .metrics import auc_ap, binary_metrics
from .ordered import ecdf
from .relational import require_coverage
from .sampling import draw, folds

MODEL = "candidate int, params string, median array<double>, kept array<int>, mean array<double>, std array<double>, chosen array<int>, origin array<double>, axes array<array<double>>, weights array<double>"


def out_of_fold(table: DataFrame, folds: DataFrame, candidates: DataFrame, key: str, vector: str, y: str) -> DataFrame:
    """(candidate, key, y, score) in which every row is scored by a model that hasn't seen it.

    folds: key and fold. candidates: candidate and params.
    """
    own = folds.select(key, F.col("fold").alias("outer_fold"))
    asked = own.select("outer_fold").distinct().crossJoin(F.broadcast(candidates.select("candidate", "params")))
    return L.fold_scores(table, own, asked, key, vector, y).filter("not inner").select("candidate", key, "y", "score")


def fit_all(table: DataFrame, candidates: DataFrame, vector: str, y: str) -> DataFrame:
    """One row a candidate: its chain fitted to all of the table, as numbers that ``apply_models`` reads."""
    rows = kept(table.select(F.col(vector).cast("array<double>").alias("_x"), F.col(y).cast("int").alias("_y"), F.array(F.lit(0)).alias("train")), "whole")
    asked = [(r["candidate"], r["params"]) for r in candidates.select("candidate", "params").orderBy("candidate").collect()]
    found = fits.fitted(rows, 1, lambda s, n: [L.from_text(p) for _, p in asked])
    if not found:
        raise ValueError("a model needs rows of both classes")
    told = []
    for (number, params), f in zip(asked, found[0], strict=True):
        axes = None if f.rotation.axes is None else f.rotation.axes.T.tolist()
        prep = f.prep
        told.append((number, params, prep.median.tolist(), prep.kept.tolist(), prep.mean.tolist(), prep.std.tolist(), f.rotation.chosen.tolist(), [0.0] * len(f.rotation.chosen), axes, f.w.tolist()))
    return table.sparkSession.createDataFrame(told, MODEL)


def apply_models(models: DataFrame, table: DataFrame, key: str, vector: str) -> DataFrame:
    """(candidate, key, score) of stored models on any table, worked out inside the JVM without refitting."""
    x = F.col(vector)
    m = table.select(key, x.cast("array<double>").alias(vector)).crossJoin(models.drop("params"))
    full = F.transform(x, lambda v, i: F.when(v.isNull() | F.isnan(v), F.get("median", i)).otherwise(v))
    scaled = F.transform("kept", lambda j, i: (F.get(full, j) - F.get("mean", i)) / F.get("std", i))
    picked = F.transform("chosen", lambda j: F.get(scaled, j))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    m = m.withColumn("_u", picked)
    turned = F.when(F.col("axes").isNull(), F.col("_u")).otherwise(F.transform("axes", lambda a: dot(a, F.zip_with("_u", "origin", lambda u, o: u - o))))
    m = m.withColumn("_t", turned)
    n = F.size("weights") - 1
    return m.select("candidate", key, (1 / (1 + F.exp(-(dot(F.col("_t"), F.slice("weights", 1, n)) + F.element_at("weights", -1))))).alias("score"))


def stacked_external(models: DataFrame, oof: DataFrame, table: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, score) on a new cohort: stored models' scores on the scale of their out-of-fold scores, averaged by how far the out-of-fold AUC is above a half."""
    weights = auc_ap(oof, ["candidate"], "y", "score").select("candidate", F.greatest(F.coalesce("auc", F.lit(0.5)) - 0.5, F.lit(0.001)).alias("_w"))
    placed = ecdf(oof, apply_models(models, table, key, vector), ["candidate"], "score", "z").join(weights, "candidate")
    return placed.groupBy(key).agg((F.sum(F.col("z") * F.col("_w")) / F.sum("_w")).alias("score"))


def candidate_status(scores: DataFrame, train: DataFrame, held: DataFrame, key: str, least: float) -> DataFrame:
    """(candidate, coverage, missing_train, missing_held, examples, kept): whether a candidate scores enough of the training keys and all held-out ones.

    scores: candidate, key and score. A candidate without is named with the first eight keys that it
    misses. Only keys are paired with candidates, of which there are few; examples are the least
    keys of partial lists, so no task gathers what is missing.
    """
    names = scores.select("candidate").distinct()
    asked = train.select(key, F.lit(True).alias("_train")).distinct().unionByName(held.select(key, F.lit(False).alias("_train")).distinct())
    known = scores.filter(F.col("score").isNotNull() & ~F.isnan("score")).select("candidate", key).distinct().withColumn("_there", F.lit(True))
    met = asked.crossJoin(F.broadcast(names)).join(known, ["candidate", key], "left").withColumn("_gone", F.col("_there").isNull())
    counts = met.groupBy("candidate").agg(
        F.count_if("_train").alias("_n"), F.count_if(F.col("_train") & F.col("_gone")).alias("missing_train"), F.count_if(~F.col("_train") & F.col("_gone")).alias("missing_held"),
    )
    gone = met.filter("_gone").withColumn("_r", F.row_number().over(Window.partitionBy("candidate").orderBy(key))).filter("_r <= 8")
    examples = gone.groupBy("candidate").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    coverage = F.coalesce(1 - F.try_divide(F.col("missing_train"), F.col("_n")), F.lit(0.0))
    told = counts.join(examples, "candidate", "left").withColumn("coverage", coverage)
    told = told.withColumn("examples", F.coalesce("examples", F.array().cast(f"array<{train.schema[key].dataType.simpleString()}>")))
    return told.select("candidate", "coverage", "missing_train", "missing_held", "examples", ((F.col("coverage") >= least) & (F.col("missing_held") == 0)).alias("kept"))


def best_bases(oof: DataFrame, k: int) -> DataFrame:
    """The k candidates with the largest out-of-fold AUC; those without one come last."""
    ranked = auc_ap(oof, ["candidate"], "y", "score").withColumn("_v", F.coalesce("auc", F.lit(-1.0)))
    return ranked.orderBy(F.desc("_v"), "candidate").limit(k).select("candidate", "auc")


def nested_run(table: DataFrame, nested: DataFrame, own: DataFrame, key: str, vector: str, y: str, grid: dict, file: str) -> dict[str, DataFrame]:
    """The sheets of one nested evaluation: inner scores, chosen parameters and held-out predictions, complete or not at all."""
    inner = L.inner_search(table, nested, key, vector, y, grid)
    chosen = L.best_parameters(inner)
    predictions = L.outer_scores(table, own, chosen, key, vector, y).filter("not inner").drop("inner")
    predictions = predictions.withColumn("pred", (F.col("score") >= 0.5).cast("int")).withColumn("file", F.lit(file))
    require_coverage(own.join(chosen.select("outer_fold"), "outer_fold", "left_semi"), predictions, [key])
    return {"inner": inner, "parameters": chosen, "predictions": predictions}


def candidates_of(spark, params: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([(k, L.as_text(p)) for k, p in enumerate(params)], "candidate int, params string")


def fixed_candidate(train: DataFrame, rows: DataFrame, params: dict, key: str, vector: str, y: str) -> DataFrame:
    """(key, score): one candidate fitted on the training rows and applied to others."""
    models = fit_all(train, candidates_of(train.sparkSession, [params]), vector, y)
    return apply_models(models, rows, key, vector).select(key, "score")


def inner_folds(table: DataFrame, own: DataFrame, key: str, y: str, k: int, seed: int) -> DataFrame:
    """(key, outer_fold, inner_fold): every outer fold's training keys, dealt within their class. own: key and outer_fold."""
    outer = own.select(F.col("outer_fold").alias("_outer")).distinct()
    train = own.join(table.select(key, y), key).crossJoin(F.broadcast(outer)).filter("outer_fold <> _outer")
    dealt = folds(train.select(key, F.col("_outer").alias("outer_fold"), F.col(y).alias("_y")), ["outer_fold", "_y"], k, [draw(seed, F.col(key).cast("string")), key], "inner_fold", pieces=False)
    return dealt.select(key, "outer_fold", "inner_fold")


def stacking(table: DataFrame, own: DataFrame, params: Sequence[dict], key: str, vector: str, y: str, inner: int = 4, seed: int = 42) -> dict[str, DataFrame]:
    """The sheets of a stacking run: base scores, stacked predictions, metrics by fold, and their mean and spread.

    own: key and outer_fold. Scales and weights come from out-of-fold scores of the training
    rows. Raises where a key has no features, or a prediction is missing.
    """
    require_coverage(own, table.select(key), [key])
    spark = table.sparkSession
    bases = L.base_scores(table, inner_folds(table, own, key, y, inner, seed), own, candidates_of(spark, params), key, vector, y)
    stacked = L.meta_scores(bases, key).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    require_coverage(own, stacked, [key])
    per_fold = binary_metrics(stacked, ["outer_fold"], "y", "score", "pred")
    names = [c for c in per_fold.columns if c not in ("outer_fold", "n")]
    summary = per_fold.agg(*(F.avg(c).alias(f"{c}_mean") for c in names), *(F.stddev_pop(c).alias(f"{c}_std") for c in names))
    return {"bases": bases, "predictions": stacked, "folds": per_fold, "summary": summary, "candidates": candidates_of(spark, params)}


def stable_book(first: DataFrame, second: DataFrame, keys: Sequence[str], features: Sequence[str], labels: DataFrame, icc_table) -> DataFrame:
    """The second rater's stable features with their cases' labels: what two raters agree on, read from one of them."""
    kept = [r["feature"] for r in icc_table(first, second, list(keys), list(features)).filter("stable").select("feature").collect()]
    return labels.join(second.select(*keys, *(f for f in features if f in set(kept))), list(keys))
