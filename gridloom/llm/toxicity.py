"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier over the presence of words and word beginnings is trained
in numpy from confirmed toxic texts and unlabelled ones. Its risk is
``prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])``; where
the second part falls below zero, the step goes up that part instead, so that
unlabelled texts are not overfitted. Workers turn texts into hashed features,
Spark counts them over at most ``max_positive`` and ``max_unlabelled`` texts, the
driver sees these texts' chosen features alone, and every whole text is scored.

Cases: null and empty texts have no features and score the model's bias; a
document labelled more than once is toxic if any label says so; null labels and
ids are left out; without a toxic training text, or without training texts at all,
every score is next to 0 (below 1e-12). Equal rows get equal scores; very long texts
are read whole; a column called as the score is replaced, all others pass through; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, stored

LETTERS = re.compile(r"[^\W\d_]+").findall
PREFIXES = (3, 4, 5, 6)
MEMO_WORDS = 100_000
#: A feature is in so many toxic texts at least; a model has so many features at most.
LEAST, MOST = 3, 8192


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [xxhash.xxh32_intdigest(f"={word}"), *(xxhash.xxh32_intdigest(word[:n]) for n in PREFIXES if len(word) > n - 1)]


def text_features(text: str | None) -> np.ndarray:
    words = set(LETTERS(text.lower())) if text else ()
    return np.unique(np.fromiter((f for w in words for f in word_features(w)), np.uint32))


@dataclass
class Model:
    """Weights of the chosen features (by hash, ascending), and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        index = {int(f): float(w) for f, w in zip(self.features, self.weights, strict=True)}
        memo: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            hit: set[int] = set()
            if text:
                for word in set(LETTERS(text.lower())):
                    found = memo.get(word)
                    if found is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        found = memo[word] = tuple(f for f in word_features(word) if f in index)
                    if found:
                        hit.update(found)
            z = self.bias + math.fsum(index[f] for f in hit)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


EMPTY = Model(np.zeros(0, np.uint32), np.zeros(0), -math.inf)


def best(values: np.ndarray, counts: np.ndarray, there: np.ndarray, n: int, m: int, most: int, sigmas: float = 4.0) -> np.ndarray:
    """Features that n toxic texts have more often (counts) than m unlabelled ones (there), beyond chance."""
    rate = (there + 1) / (max(1, m) + 2)
    beyond = (counts - n * rate) / np.sqrt(n * rate * (1 - rate))
    good = np.flatnonzero((counts >= LEAST) & (beyond >= sigmas))
    return np.sort(values[good[np.argsort(-beyond[good], kind="stable")[:most]]])


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int) -> np.ndarray:
    """The best features of texts at hand."""
    values, counts = np.unique(np.concatenate(positive), return_counts=True)
    others, found = np.unique(np.concatenate([*unlabelled, np.zeros(0, np.uint32)]), return_counts=True)
    at = np.minimum(np.searchsorted(others, values), max(0, len(others) - 1))
    there = np.where(others[at] == values, found[at], 0) if len(others) else np.zeros(len(values))
    return best(values, counts, there, len(positive), len(unlabelled), most)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, chosen: np.ndarray | None = None, most: int = MOST, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> Model:
    """Non-negative risk minimisation by Adam over all given texts; chosen: the features, None to choose them from the texts."""
    if not positive:
        return EMPTY
    chosen = choose(positive, unlabelled, most) if chosen is None else chosen

    def rows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [np.searchsorted(chosen, t[np.isin(t, chosen, assume_unique=True)]) for t in texts]
        return np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64)

    (pr, pc), (ur, uc) = rows(positive), rows(unlabelled)
    n, m, d = len(positive), len(unlabelled), len(chosen)
    w = np.zeros(d + 1)
    w[d] = math.log(prior / (1 - prior))
    first, second = np.zeros(d + 1), np.zeros(d + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)

    def gradient(r: np.ndarray, c: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(c, slope[r], d), slope.sum())

    for step in range(1, steps + 1):
        zp = w[d] + np.bincount(pr, w[pc], n)
        zu = w[d] + np.bincount(ur, w[uc], m)
        negative = (softplus(zu).mean() if m else 0.0) - prior * softplus(zp).mean()
        of_negative = (gradient(ur, uc, sigmoid(zu) / m) if m else 0) - gradient(pr, pc, prior * sigmoid(zp) / n)
        g = gradient(pr, pc, -prior * sigmoid(-zp) / n) + of_negative if negative >= -beta else -of_negative
        g[:d] += decay * w[:d]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, w[:d], float(w[d]))


def _featured(docs: DataFrame, text: str) -> DataFrame:
    """_draw and the packed features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array((text_features(t.as_py()).tobytes() for t in batch.column(0)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), packed], names=["_draw", "_features"])

    return docs.select(text, "_draw").mapInArrow(run, T.StructType([T.StructField("_draw", T.LongType()), T.StructField("_features", T.BinaryType())]))


def _counted(texts: DataFrame) -> DataFrame:
    """(feature, counts, there): how many toxic and unlabelled texts have a feature; too rare ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(b.as_py(), np.uint32) for b in batch.column(0)]
            toxic = np.repeat(batch.column(1).to_numpy(), [len(h) for h in held]) if held else np.zeros(0, np.int64)
            features = np.concatenate([*held, np.zeros(0, np.uint32)])
            values, inverse = np.unique(features, return_inverse=True)
            counts = np.bincount(inverse, toxic == 1, len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts), pa.array(np.bincount(inverse, minlength=len(values)) - counts)], names=["feature", "counts", "there"])

    rows = texts.select("_features", "_toxic").mapInArrow(run, "feature long, counts long, there long")
    return rows.groupBy("feature").agg(F.sum("counts").alias("counts"), F.sum("there").alias("there")).filter(F.col("counts") >= LEAST)


def _reduced(texts: DataFrame, chosen: np.ndarray) -> DataFrame:
    """texts with only the chosen of their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = (np.frombuffer(b.as_py(), np.uint32) for b in batch.column(0))
            packed = pa.array((h[np.isin(h, chosen, assume_unique=True)].tobytes() for h in held), pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], names=["_features", "_toxic", "_draw"])

    return texts.select("_features", "_toxic", "_draw").mapInArrow(run, "_features binary, _toxic long, _draw long")


def learn(
    docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    prior: float | None = None, max_positive: int = 3000, max_unlabelled: int = 9000,
) -> Model:
    """A model from at most so many toxic and unlabelled texts, drawn by a hash of their ids.

    allowed: which ids of ``id_col`` may be learned from. prior: the share of toxic
    texts; None takes the share among all the labelled ids that are allowed.
    """
    ready(docs.sparkSession)
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity"))
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & allowed).groupBy(id_col).agg(F.max(label).alias("_toxic"))
    share = marked.agg(F.avg(F.col("_toxic").cast("double"))).first()[0]
    if not share:
        return EMPTY
    # At most max_positive ids: small enough to send to every task.
    some = marked.filter("_toxic = 1").orderBy(draw, id_col).limit(max_positive).select(id_col)
    source = docs.select(F.col(id_col), F.col(text), draw.alias("_draw")).filter(F.col(id_col).isNotNull() & allowed)
    toxic = _featured(source.join(F.broadcast(some), id_col, "left_semi"), text).orderBy("_draw").limit(max_positive)
    n = source.count()
    low = int(-(1 << 63) + (1 << 64) * min(1.0, 1.05 * max_unlabelled / max(n, 1))) - 1
    plain = _featured(source.filter(F.col("_draw") <= low), text).orderBy("_draw").limit(max_unlabelled)
    # Only counts of features and the chosen ones' rows come to the driver.
    texts = stored(toxic.withColumn("_toxic", F.lit(1).cast("long")).unionByName(plain.withColumn("_toxic", F.lit(0).cast("long"))), "samples")
    sizes = {r["_toxic"]: r["count"] for r in texts.groupBy("_toxic").count().collect()}
    counted = _counted(texts).toArrow()
    column = lambda name: counted.column(name).to_numpy()
    order = np.argsort(column("feature"))
    chosen = best(column("feature")[order].astype(np.uint32), column("counts")[order], column("there")[order], sizes.get(1, 0), sizes.get(0, 0), MOST)
    kept = _reduced(texts, chosen).orderBy("_draw").toArrow()
    held = [[np.frombuffer(b.as_py(), np.uint32) for b, one in zip(kept.column("_features"), kept.column("_toxic").to_numpy(), strict=True) if one == k] for k in (1, 0)]
    known = min(0.9, max(1e-4, share if prior is None else prior))
    model = fit(*held, known, chosen=chosen)
    del counted, kept
    pa.default_memory_pool().release_unused()
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df and ``out``: how likely each whole text is toxic, from 0 to 1."""
    spark = ready(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = sent.value.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            keep = [(n, batch.column(k)) for k, n in enumerate(batch.schema.names) if n != out]
            values = pa.array((one(t.as_py()) for t in texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), values], names=[*(n for n, _ in keep), out])

    return df.mapInArrow(run, T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.DoubleType())]))
