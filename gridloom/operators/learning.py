"""Leakage-controlled learning: preparation, selection, grid search, outer evaluation, stacking and bags.

Tables hold features as one array column. Linear models of all folds and candidates
are fitted together from sums over the rows (``fits``), so no task holds a fold; a
whole table's moments, quantiles and value counts are aggregates, too.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import models
from ..session import kept
from . import fits
from .metrics import auc_ap
from .ordered import ecdf


def prepared(df: DataFrame, columns: Sequence[str], quasi: float = 0.95, correlated: float = 0.95) -> tuple[DataFrame, list[str]]:
    """(df with imputed, pruned and z-scored columns, the kept ones), fitted on all of df by aggregates.

    Missing values take the median. A column goes whose commonest value has at least
    ``quasi`` of the rows, or that is correlated above ``correlated`` with any earlier one.
    """
    medians = df.agg(*(F.median(c).alias(c) for c in columns)).first().asDict()
    full = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0))) for c in columns})
    n = full.count()
    counts = full.select(*columns).unpivot([], list(columns), "c", "v").groupBy("c", "v").count().groupBy("c").agg(F.max("count").alias("most"))
    share = {r["c"]: r["most"] / max(1, n) for r in counts.collect()}
    kept = [c for c in columns if share.get(c, 1.0) < quasi]
    if not kept:
        spread = full.agg(*(F.var_pop(c).alias(c) for c in columns)).first().asDict()
        kept = [max(columns, key=lambda c: spread[c] or 0.0)]
    stats = full.agg(*(F.avg(c).alias(f"m_{c}") for c in kept), *(F.stddev_pop(c).alias(f"s_{c}") for c in kept)).first().asDict()
    if n and len(kept) > 1:
        z = F.array(*((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in kept))
        high = np.abs(correlations(moments(full.select(z.alias("z")), "z")[2])) > correlated
        kept = [c for k, c in enumerate(kept) if not high[k, :k].any()]
    scaled = {c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in kept}
    return full.drop(*(c for c in columns if c not in kept)).withColumns(scaled), kept


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of an array column; no rows give 0 and empty arrays.

    Scan tasks send sums, not rows: the Gram matrix of the vectors with a one appended, a row of
    it at a time. Each of its rows is added up in a task of its own, and the driver gets one matrix.
    """

    def run(batches):
        gram = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy())
                x = np.hstack([x, np.ones((len(x), 1))])
                gram = x.T @ x if gram is None else gram + x.T @ x
        if gram is not None:
            yield pd.DataFrame({"axis": range(len(gram)), "sums": list(gram)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"axis": [pdf["axis"].iloc[0]], "sums": [pdf["sums"].sum()]})

    schema = "axis int, sums array<double>"
    parts = df.select(F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, schema).groupBy("axis").applyInPandas(add, schema).collect()
    if not parts:
        return 0, np.zeros(0), np.zeros((0, 0))
    gram = np.array([p["sums"] for p in sorted(parts, key=lambda p: p["axis"])])
    n, mean = gram[-1, -1], gram[-1, :-1] / gram[-1, -1]
    return int(n), mean, gram[:-1, :-1] / n - np.outer(mean, mean)


def correlations(covariance: np.ndarray) -> np.ndarray:
    """Correlations of a covariance matrix; 0 with a column that doesn't vary or isn't a number."""
    spread = np.sqrt(np.diag(covariance).clip(0))
    below = np.outer(spread, spread)
    return np.nan_to_num(np.divide(covariance, below, out=np.zeros_like(covariance), where=below > 1e-12), nan=0.0)


def variance_shares(df: DataFrame, vector: str) -> list[tuple[int, float, float]]:
    """(axis from 1, share, cumulative share) of the variance along principal axes."""
    values = np.linalg.eigvalsh(moments(df, vector)[2])[::-1].clip(0)
    share = values / max(values.sum(), 1e-300)
    return [(k + 1, float(s), float(c)) for k, (s, c) in enumerate(zip(share, share.cumsum(), strict=True))]


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """df with ``_weight``: each class weighs the same in total."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return df.join(counts.crossJoin(total).select(y, (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("_weight")), y)


def logistic(df: DataFrame, vector: str, y: str, c: float, l1: bool) -> np.ndarray:
    """Coefficients, the intercept last, fitted by MLlib with the objective |w| or |w|^2 / 2 plus c times the weighted log loss."""
    data = class_weights(df, y).select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"), F.col(y).cast("double").alias("label"), "_weight")
    n = data.count()
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="_weight", elasticNetParam=1.0 if l1 else 0.0, regParam=1 / (c * n), standardization=False, maxIter=200, tol=1e-8).fit(data)
    return np.append(fit.coefficients.toArray(), fit.intercept)


def linear_score(vector: Column, w: np.ndarray) -> Column:
    """The probability that coefficients with the intercept last give, inside the JVM."""
    z = F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(v)) for v in w[:-1])), lambda a, b: a * b), F.lit(float(w[-1])), lambda acc, v: acc + v)
    return 1 / (1 + F.exp(-z))


#: The grid of a nested evaluation: selector strengths and sizes, variance shares, and models with their parameter.
GRID = {"c": (0.05, 0.1, 0.5, 1.0), "k": (10, 15, 20, 30), "pca": (None, 0.9, 0.95, 0.99), "model": (*(("lr", c) for c in (0.1, 0.3, 1.0, 3.0)), *(("lda", s) for s in (None, 0.2, 0.5)))}


def as_text(params: dict) -> str:
    return json.dumps({**params, "model": list(params["model"])}, sort_keys=True)


def grid_of(grid: dict, features: int) -> list[dict]:
    return [{"c": c, "k": k, "pca": p, "model": m} for c in grid["c"] for k in grid["k"] if k <= features for p in grid["pca"] for m in grid["model"]] or [
        {"c": c, "k": features, "pca": p, "model": m} for c in grid["c"] for p in grid["pca"] for m in grid["model"]
    ]


def in_sets(table: DataFrame, placed: DataFrame, key: str, vector: str, y: str, sets: Sequence[tuple[int, int | None]]) -> DataFrame:
    """Kept rows (key, _x, _y, train, test) with the numbers of the sets that each trains and tests.

    placed: key, outer_fold and inner_fold, null where the outer fold holds the key out. A set
    (outer, inner) tests that inner fold and trains on the outer fold's others; (outer, None)
    tests what the outer fold holds out and trains on all the rest of it.
    """
    own = placed.groupBy(key).agg(F.collect_list(F.struct(F.col("outer_fold").alias("o"), F.coalesce("inner_fold", F.lit(-1)).alias("i"))).alias("_own"))
    all_sets = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(o).alias("o"), F.lit(-1 if i is None else i).alias("i")) for k, (o, i) in enumerate(sets)))
    tests = lambda s: F.exists("_own", lambda f: (f["o"] == s["o"]) & (f["i"] == s["i"]))
    trains = lambda s: F.exists("_own", lambda f: (f["o"] == s["o"]) & (f["i"] != s["i"]) & (f["i"] >= 0))
    numbers = lambda chosen: F.transform(F.filter(all_sets, chosen), lambda s: s["n"])
    rows = table.select(key, F.col(vector).cast("array<double>").alias("_x"), F.col(y).cast("int").alias("_y")).join(own, key)
    return kept(rows.select(key, "_x", "_y", numbers(trains).alias("train"), numbers(tests).alias("test")), "sets")


def inner_search(table: DataFrame, splits: DataFrame, key: str, vector: str, y: str, grid: dict = GRID) -> DataFrame:
    """(outer_fold, inner_fold, position, params, auc, ap) of every candidate on every inner fold.

    splits: key, outer_fold and inner_fold, one row a training key. All folds' candidates are
    fitted together from sums (see ``fits``), and held-out scores are ranked by fold and
    candidate (``fits.areas``); a fold with one class gives nothing.
    """
    sets = sorted(tuple(r) for r in splits.select("outer_fold", "inner_fold").distinct().collect())
    rows = in_sets(table, splits, key, vector, y, sets)
    found = fits.fitted(rows, len(sets), lambda s, n: grid_of(grid, n))
    named = [(s, at, *sets[s], as_text(f.params)) for s, fs in found.items() for at, f in enumerate(fs)]
    names = table.sparkSession.createDataFrame(named, "set int, position int, outer_fold int, inner_fold int, params string")
    told = fits.areas(rows, found, key, "test").filter("auc is not null")
    return told.join(names, ["set", "position"]).select("outer_fold", "inner_fold", "position", "params", "auc", "ap")


def best_parameters(scores: DataFrame) -> DataFrame:
    """Each outer fold's candidate with the largest mean AUC, then mean AP, then smallest AUC spread, then first place; incomplete ones are out."""
    per = scores.groupBy("outer_fold", "position", "params").agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"), F.stddev_pop("auc").alias("std"), F.count("auc").alias("n"))
    full = per.groupBy("outer_fold").agg(F.max("n").alias("_most"))
    complete = per.join(full, "outer_fold").filter("n = _most and not isnan(auc)")
    key = F.struct("auc", "ap", -F.col("std"), -F.col("position"))
    return complete.groupBy("outer_fold").agg(F.max_by(F.struct("params", "auc", "ap", "std"), key).alias("b")).select("outer_fold", "b.params", F.col("b.auc").alias("inner_auc"), F.col("b.ap").alias("inner_ap"), F.col("b.std").alias("inner_std"))


def from_text(params: str) -> dict:
    told = json.loads(params)
    return {**told, "model": tuple(told["model"])}


def fold_scores(table: DataFrame, folds: DataFrame, candidates: DataFrame, key: str, vector: str, y: str) -> DataFrame:
    """(outer_fold, candidate, key, y, score, inner): candidates fitted on each outer fold's training rows and applied to all rows; inner marks training rows.

    folds: key and outer_fold, the fold that holds the key out. candidates: outer_fold, candidate and params, few.
    """
    asked: dict[int, list[tuple[int, dict]]] = {}
    for r in candidates.select("outer_fold", "candidate", "params").orderBy("outer_fold", "candidate").collect():
        asked.setdefault(r["outer_fold"], []).append((r["candidate"], from_text(r["params"])))
    sets, spark = sorted(asked), table.sparkSession
    own = folds.select(key, F.col("outer_fold").alias("_own"))
    numbers = lambda rule: F.transform(F.filter(F.array(*(F.struct(F.lit(k).alias("n"), F.lit(o).alias("o")) for k, o in enumerate(sets))), rule), lambda s: s["n"])
    rows = table.select(key, F.col(vector).cast("array<double>").alias("_x"), F.col(y).cast("int").alias("_y")).join(own, key)
    rows = kept(rows.select("*", numbers(lambda s: s["o"] != F.col("_own")).alias("train"), numbers(lambda s: F.lit(True)).alias("test")), "sets")
    found = fits.fitted(rows, len(sets), lambda s, n: [p for _, p in asked[sets[s]]])
    names = spark.createDataFrame([(k, at, o, c) for k, o in enumerate(sets) for at, (c, _) in enumerate(asked[o])], "set int, position int, outer_fold int, candidate int")
    made = fits.scored(rows, found, key, "test").join(names, ["set", "position"]).join(rows.select(key, "_own"), key)
    return made.select("outer_fold", "candidate", key, "y", "score", (F.col("_own") != F.col("outer_fold")).alias("inner"))


def outer_scores(table: DataFrame, folds: DataFrame, chosen: DataFrame, key: str, vector: str, y: str) -> DataFrame:
    """(outer_fold, key, y, score, inner): ``fold_scores`` of one candidate a fold. chosen: outer_fold and params."""
    one = chosen.select("outer_fold", F.lit(0).alias("candidate"), "params")
    return fold_scores(table, folds, one, key, vector, y).drop("candidate")


def base_scores(table: DataFrame, nested: DataFrame, own: DataFrame, candidates: DataFrame, key: str, vector: str, y: str) -> DataFrame:
    """(candidate, outer_fold, key, y, score, inner): what a stack may be built from.

    Held-out rows (inner false) are scored by a candidate fitted on their outer fold's training
    rows; each training row (inner true) by one fitted on the other inner folds' rows, so no
    row is scored by a model that has seen it. own: key and outer_fold, the fold that holds
    the key out. nested: key, outer_fold and inner_fold of its training keys. candidates:
    candidate and params, few. An inner fold whose other rows lack a class gives no scores.
    """
    placed = nested.select(key, "outer_fold", "inner_fold").unionByName(own.select(key, "outer_fold", F.lit(None).cast("int").alias("inner_fold")))
    sets = sorted((tuple(r) for r in placed.select("outer_fold", "inner_fold").distinct().collect()), key=lambda s: (s[0], -1 if s[1] is None else s[1]))
    asked = [(r["candidate"], from_text(r["params"])) for r in candidates.select("candidate", "params").orderBy("candidate").collect()]
    rows = in_sets(table, placed, key, vector, y, sets)
    found = fits.fitted(rows, len(sets), lambda s, n: [p for _, p in asked])
    named = [(k, at, c, o, i is not None) for k, (o, i) in enumerate(sets) for at, (c, _) in enumerate(asked)]
    names = table.sparkSession.createDataFrame(named, "set int, position int, candidate int, outer_fold int, inner boolean")
    return fits.scored(rows, found, key, "test").join(names, ["set", "position"]).select("candidate", "outer_fold", key, "y", "score", "inner")


def meta_scores(candidates: DataFrame, key: str, least: float = 0.001) -> DataFrame:
    """(outer_fold, key, y, score): candidates' held-out scores put on the scale of their out-of-fold training scores, then averaged by how far the AUC of these is above a half.

    candidates: candidate, outer_fold, key, y, score and inner, as ``base_scores`` gives them. A candidate that lacks a training score is out.
    """
    train, test = candidates.filter("inner"), candidates.filter("not inner")
    groups = ["candidate", "outer_fold"]
    weights = auc_ap(train, groups, "y", "score").select(*groups, F.greatest(F.col("auc") - 0.5, F.lit(least)).alias("_w"))
    placed = ecdf(train, test, groups, "score", "z").join(weights, groups)
    return placed.groupBy("outer_fold", key, "y").agg((F.sum(F.col("z") * F.col("_w")) / F.sum("_w")).alias("score"))


def bag_scores(instances: DataFrame, bag: str, vector: str, net: models.MaxPool) -> DataFrame:
    """Each bag's score: hidden units by instance, their largest over the bag by an aggregate, then the output layer."""

    def run(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({bag: batch[bag], "h": list(net.instances(np.stack(batch[vector].to_numpy()).astype(float))[1])})

    kind = instances.schema[bag].dataType.simpleString()
    hidden = instances.select(bag, vector).mapInPandas(run, f"{bag} {kind}, h array<double>")
    width = net.w[2].shape[0]
    pooled = hidden.groupBy(bag).agg(*(F.max(F.col("h")[k]).alias(f"h{k}") for k in range(width)))
    return pooled.select(bag, linear_score(F.array(*(F.col(f"h{k}") for k in range(width))), np.append(net.w[2][:, 0], net.b[2][0])).alias("score"))


def inner_parts(y: np.ndarray, inner: int, seed: int) -> np.ndarray:
    """Each bag's inner fold, dealt within its class."""
    r, part = np.random.default_rng(seed), np.zeros(len(y), np.int64)
    for label in np.unique(y):
        own = r.permutation(np.flatnonzero(y == label))
        part[own] = np.arange(len(own)) % inner
    return part


def train_bags(instances: DataFrame, bag: str, vector: str, y: str, fold: str, hidden: int = 64, epochs: int = 120, patience: int = 20, inner: int = 4, seed: int = 42) -> DataFrame:
    """(fold, bag, y, score): the mean of a fold's networks, each trained on the other folds' bags but for an inner fold, whose AUC stops it.

    Scale and weights come from a network's training bags alone. An inner fold that leaves
    one class gives no network; a fold without any is an error.
    """
    members = instances.select(F.col(fold).alias("held")).distinct().withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    kind = instances.schema[bag].dataType
    # A task holds its rows once, in the type in which they lose nothing, and scales a batch of bags at a time.
    single = instances.agg(F.every(F.forall(vector, lambda v: v.cast("float").cast("double").eqNullSafe(v.cast("double"))))).first()[0]
    sent = instances.select(bag, F.col(vector).cast("array<float>" if single else "array<double>").alias("_x"), F.col(y).cast("int").alias("_y"), F.col(fold).alias("_fold"))
    schema = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField(bag, kind), T.StructField("y", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fold_, member = (k.as_py() for k in keys)
        names, truth, folds_ = table.column(bag).combine_chunks(), table.column("_y").to_numpy(), table.column("_fold").to_numpy()
        order = pc.sort_indices(names)
        x = table.column("_x").combine_chunks()
        del table
        x = x.flatten().to_numpy().reshape(len(names), -1)
        order = order.to_numpy()
        if (np.diff(order.astype(np.int64)) != 1).any():
            x, names, truth, folds_ = x[order], names.take(pa.array(order)), truth[order], folds_[order]
        begins = np.flatnonzero(np.append(True, np.diff(pd.factorize(names.to_numpy(zero_copy_only=False))[0]) != 0))
        every = models.Bags(x, begins, np.append(begins[1:], len(x)))
        truth, of = truth[begins], folds_[begins]
        known, test = np.flatnonzero(of != fold_), np.flatnonzero(of == fold_)
        part = inner_parts(truth[known], inner, seed + int(fold_))
        usable = [k for k in range(inner) if (part == k).any() and len(set(truth[known][part != k])) == 2]
        if not usable:
            raise ValueError(f"fold {fold_}: no inner fold leaves bags of both classes")
        if member not in usable:
            test, scores = test[:0], np.zeros(0)
        else:
            own, held = known[part != member], known[part == member]
            train = every.of(own).scaled()
            scaled = models.Bags(x, every.begins, every.ends, train.mean, train.std)
            net = models.MaxPool(x.shape[1], hidden, seed * 100 + int(member))
            net.fit(train, truth[own], (scaled.of(held), truth[held]), epochs, patience=patience, seed=seed * 100 + int(member))
            scores = np.concatenate([net.scores(rows, first) for rows, first in scaled.of(test).pieces()])
        return pa.table([pa.array(np.full(len(test), int(fold_), np.int32)), names.take(pa.array(begins[test])), pa.array(truth[test].astype(np.int32)), pa.array(scores)], names=schema.names)

    made = sent.crossJoin(F.broadcast(members)).groupBy("held", "member").applyInArrow(run, schema)
    return made.groupBy("fold", bag, "y").agg(F.avg("score").alias("score"))
