"""Linear models of many training sets and candidates at once, fitted from sums.

A row carries the numbers of the training sets that it belongs to. A pass over the rows
adds up, in each task, what every open problem needs of them: value counts, moments by
class, or a likelihood with its gradient and Hessian. Trees of tasks add up the tasks'
sums, and a problem's next step is worked out where its sum ends up. So no task ever
holds a set's rows, whatever their number; the driver holds coefficients alone. Memory
of a task is the sums of the problems of one pass, ``PASS_BYTES`` at most (or one
problem); more problems take more passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..session import kept
from .metrics import auc_ap
from .ordered import running

PASS_BYTES = 64 << 20
#: Tasks' sums that one task adds up; more of them are added up in two levels.
FAN = 64
STEPS, TOLERANCE = 60, 1e-9


def summed(rows: DataFrame, partial: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]], finish: Callable[[int, np.ndarray], tuple], schema: str, op: np.ufunc = np.add) -> DataFrame:
    """finish(problem, sum) as a row for every problem; ``partial`` gives a batch's terms, and ``op`` adds them up or takes the least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for problem, term in partial(pdf):
                held[problem] = op(held[problem], term) if problem in held else term
        if held:
            yield pd.DataFrame({"problem": list(held), "part": TaskContext.get().partitionId(), "sums": list(held.values())})

    def added(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"problem": [keys[0]], "part": [keys[1]], "sums": [op.reduce(np.stack(pdf["sums"].to_numpy()))]})

    def last(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([finish(int(keys[0]), op.reduce(np.stack(pdf["sums"].to_numpy())))], columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    # A task takes its rows batch by batch, so few long tasks need no more memory than many, and give fewer sums to move.
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(tasks).mapInPandas(run, "problem int, part int, sums array<double>")
    if tasks > FAN:
        level = parts.groupBy("problem", F.pmod("part", F.lit(FAN)).alias("part"))
        parts = level.applyInPandas(added, "problem int, part int, sums array<double>")
    return parts.groupBy("problem").applyInPandas(last, schema)


def features_of(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["_x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 0))


def members(pdf: pd.DataFrame, column: str, sets: int) -> np.ndarray:
    """Which rows are in which sets."""
    told = np.zeros((len(pdf), sets), bool)
    for k, own in enumerate(pdf[column]):
        told[k, np.asarray(own, int)] = True
    return told


@dataclass
class Prepared:
    """A set's imputation, kept features and scale, as ``models.Preparation`` has them, and its class sizes."""

    median: np.ndarray
    kept: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    sizes: tuple[int, int]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.median, x)[:, self.kept] - self.mean) / self.std

    def weights(self, y: np.ndarray) -> np.ndarray:
        """Both classes weigh the same in the set."""
        n0, n1 = self.sizes
        return np.where(y == 1, (n0 + n1) / (2 * max(1, n1)), (n0 + n1) / (2 * max(1, n0)))


def value_counts(rows: DataFrame) -> DataFrame:
    """(set, feature, median, commonest): by set and feature, exact, from counts by value that are ranked in ranges."""
    long = rows.select("train", F.posexplode(F.col("_x").cast("array<double>")).alias("feature", "v"))
    # Rows with the same sets count together before the sets are told apart.
    counts = long.groupBy("train", "feature", F.when(~F.isnan("v"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.select(F.explode("train").alias("set"), "feature", "v", "n").groupBy("set", "feature", "v").agg(F.sum("n").alias("n"))
    per = kept(per, "counts")
    ranked = running(per.filter("v is not null"), ["set", "feature"], "v", ["n"])
    at = lambda place: F.min(F.when(F.col("n_upto") > place, F.col("v")))
    middle = (at(F.floor((F.col("n_all") - 1) / 2)) + at(F.floor(F.col("n_all") / 2))) / 2
    medians = per.select("set", "feature").distinct().join(ranked.groupBy("set", "feature").agg(middle.alias("median")), ["set", "feature"], "left").fillna(0.0, ["median"])
    # What is missing counts as the median.
    filled = per.join(medians, ["set", "feature"]).groupBy("set", "feature", "median", F.coalesce("v", "median").alias("v")).agg(F.sum("n").alias("n"))
    return filled.groupBy("set", "feature", "median").agg(F.max("n").alias("commonest"), F.sum("n").alias("rows"))


#: Bits of a value that a pass of ``middles`` tells, and those that a value has.
DIGIT, BITS = 8, 64


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles, both zeros the same."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, np.uint64)
    return np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(np.float64)


def middles(rows: DataFrame, sets: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(medians of each set's features, the share of its rows that have the median or lack a value), exact, from sums.

    The lower middle is found digit by digit: a pass counts, by set and feature, the next
    digit of the values that begin with the digits found so far. A last pass counts what
    ties with it and takes the least value above, the upper middle of an even number.
    """
    sc = rows.sparkSession.sparkContext

    def over(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        if len(pdf):
            x, inside = features_of(pdf), members(pdf, "train", sets)
            for s in np.flatnonzero(inside.any(axis=0)):
                yield int(s), x[inside[:, s]]

    def gathered(term: Callable[[int, np.ndarray], np.ndarray], op: np.ufunc = np.add) -> dict[int, np.ndarray]:
        made = summed(rows, lambda pdf: ((s, term(s, x)) for s, x in over(pdf)), lambda s, total: (s, total), "set int, sums array<double>", op)
        return {r["set"]: np.array(r["sums"]) for r in made.collect()}

    sizes = gathered(lambda s, x: np.append((~np.isnan(x)).sum(axis=0), len(x)).astype(float))
    n = {s: v[:-1].astype(np.int64) for s, v in sizes.items()}
    prefix = {s: np.zeros(len(v), np.uint64) for s, v in n.items()}
    rest = {s: (v - 1) // 2 for s, v in n.items()}
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        told = sc.broadcast(prefix)

        def digits(s: int, x: np.ndarray, told=told, shift=shift) -> np.ndarray:
            u, d = ordered_bits(x), x.shape[1]
            # Shifts by all bits aren't defined, so the first pass takes every value.
            own = ~np.isnan(x) if shift + DIGIT == BITS else ~np.isnan(x) & (u >> np.uint64(shift + DIGIT) == told.value[s])
            at = ((u >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64) + (np.arange(d) << DIGIT)
            return np.bincount(at[own], minlength=d << DIGIT).astype(float)

        for s, counts in gathered(digits).items():
            upto = counts.reshape(len(n[s]), -1).cumsum(axis=1)
            digit = np.minimum((upto <= rest[s][:, None]).sum(axis=1), (1 << DIGIT) - 1)
            below = np.where(digit > 0, np.take_along_axis(upto, np.maximum(digit - 1, 0)[:, None], 1)[:, 0], 0)
            rest[s] = rest[s] - below.astype(np.int64)
            prefix[s] = (prefix[s] << np.uint64(DIGIT)) | digit.astype(np.uint64)
        told.unpersist()
    low = {s: np.where(n[s] > 0, from_bits(u), 0.0) for s, u in prefix.items()}
    told = sc.broadcast(low)
    upto = gathered(lambda s, x: (x <= told.value[s]).sum(axis=0).astype(float))
    above = gathered(lambda s, x: np.where(x > told.value[s], x, np.inf).min(axis=0), np.minimum)
    medians = {s: np.where(n[s] == 0, 0.0, np.where(upto[s] > n[s] // 2, v, (v + np.where(upto[s] > n[s] // 2, v, above[s])) / 2)) for s, v in low.items()}
    told.unpersist()
    told = sc.broadcast(medians)
    same = gathered(lambda s, x: (np.isnan(x) | (x == told.value[s])).sum(axis=0).astype(float))
    told.unpersist()
    return medians, {s: v / sizes[s][-1] for s, v in same.items()}


def prepared(rows: DataFrame, sets: int, quasi: float = 0.95, correlated: float = 0.95, both: bool = True) -> tuple[dict[int, Prepared], DataFrame]:
    """(each set's preparation, a kept table of its z-scored features' Gram matrix by class); sets with one class are out, unless not ``both`` are needed."""
    if quasi > 0.5:
        # A value that more than half of the rows have is their median.
        medians, shares = middles(rows, sets)
    else:
        told: dict[int, list] = {}
        for r in value_counts(rows).collect():
            told.setdefault(r["set"], []).append((r["feature"], r["median"], r["commonest"] / r["rows"]))
        columns = {s: list(zip(*sorted(f), strict=True)) for s, f in told.items()}
        medians = {s: np.array(c[1], float) for s, c in columns.items()}
        shares = {s: np.array(c[2], float) for s, c in columns.items()}

    def partial(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        if not len(pdf):
            return
        x, y, inside = features_of(pdf), pdf["_y"].to_numpy(int), members(pdf, "train", sets)
        for s in np.flatnonzero(inside.any(axis=0)):
            full = np.where(np.isnan(x), medians[s], x)
            grams = [(a := np.hstack([full[own], np.ones((own.sum(), 1))])).T @ a for k in (0, 1) for own in [inside[:, s] & (y == k)]]
            yield int(s), np.concatenate([g.ravel() for g in grams])

    def finish(s: int, total: np.ndarray) -> tuple:
        grams = total.reshape(2, len(medians[s]) + 1, -1)
        n0, n1 = (int(round(g[-1, -1])) for g in grams)
        if both and not (n0 and n1):
            return s, [], [], [], n0, n1, [], []
        whole, n = grams.sum(axis=0), n0 + n1
        mean = whole[-1, :-1] / n
        covariance = whole[:-1, :-1] / n - np.outer(mean, mean)
        own = np.flatnonzero(shares[s] < quasi)
        if not len(own):
            own = np.array([np.diag(covariance).argmax()])
        spread = np.sqrt(np.diag(covariance).clip(0))
        below = np.outer(spread, spread)[np.ix_(own, own)]
        tied = np.divide(covariance[np.ix_(own, own)], below, out=np.zeros_like(below), where=below > 1e-12)
        own = own[models.independent(np.nan_to_num(tied), correlated)]
        std = np.where(spread[own] > 0, spread[own], 1.0)
        at = np.append(own, len(mean))
        # z = (x - mean) / std as a matrix on (x, 1), so the Gram matrix of (z, 1) follows from that of (x, 1).
        turn = np.zeros((len(at), len(at)))
        turn[:-1, :-1], turn[-1, :-1], turn[-1, -1] = np.diag(1 / std), -mean[own] / std, 1.0
        z = [(turn.T @ g[np.ix_(at, at)] @ turn).ravel() for g in grams]
        return s, own, mean[own], std, n0, n1, *z

    schema = "set int, kept array<int>, mean array<double>, std array<double>, n0 long, n1 long, gram0 array<double>, gram1 array<double>"
    table = kept(summed(rows, partial, finish, schema), "grams")
    found = table.filter("n0 > 0 and n1 > 0" if both else "n0 + n1 > 0").select("set", "kept", "mean", "std", "n0", "n1").collect()
    return {r["set"]: Prepared(medians[r["set"]], np.array(r["kept"], int), np.array(r["mean"]), np.array(r["std"]), (r["n0"], r["n1"])) for r in found}, table


@dataclass
class Rotation:
    """The chosen features of a set's z-scores, rotated onto principal axes if there are any; and class moments on these axes."""

    chosen: np.ndarray
    axes: np.ndarray | None
    means: np.ndarray
    within: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return z[:, self.chosen] if self.axes is None else z[:, self.chosen] @ self.axes

    @property
    def width(self) -> int:
        return self.within.shape[0]


def rotations(grams: DataFrame, wanted: Mapping[int, Mapping[tuple, np.ndarray]]) -> dict[int, dict[tuple, Rotation]]:
    """By set and (name, share): the chosen features' axes that reach the share of the variance, from Gram matrices.

    wanted: by set and (name, share) the places of the chosen features; share None keeps them as they are.
    """
    keys = {s: list(w) for s, w in wanted.items()}

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, g0, g1 in zip(pdf["set"], pdf["gram0"], pdf["gram1"], strict=True):
                if s not in wanted:
                    continue
                width = int(np.sqrt(len(g0)))
                grams_ = [np.asarray(g).reshape(width, width) for g in (g0, g1)]
                for k, (name, share) in enumerate(keys[s]):
                    at = np.append(wanted[s][name, share], width - 1)
                    own = [g[np.ix_(at, at)] for g in grams_]
                    n = [g[-1, -1] for g in own]
                    means = np.stack([g[-1, :-1] / c for g, c in zip(own, n, strict=True)])
                    within = sum(g[:-1, :-1] - np.outer(m, m) * c for g, m, c in zip(own, means, n, strict=True)) / sum(n)
                    axes = None
                    if share is not None:
                        mean = (n[0] * means[0] + n[1] * means[1]) / sum(n)
                        values, vectors = np.linalg.eigh((own[0] + own[1])[:-1, :-1] / sum(n) - np.outer(mean, mean))
                        order = values.argsort()[::-1]
                        reached = np.cumsum(values[order]) / max(values.sum(), 1e-300)
                        axes = vectors[:, order[: int(np.searchsorted(reached, share - 1e-12)) + 1]]
                        means, within = means @ axes, axes.T @ within @ axes
                    out.append((s, k, None if axes is None else axes.ravel(), means.ravel(), within.ravel()))
            yield pd.DataFrame(out, columns=["set", "k", "axes", "means", "within"])

    schema = "set int, k int, axes array<double>, means array<double>, within array<double>"
    found: dict[int, dict[tuple, Rotation]] = {s: {} for s in wanted}
    for r in grams.select("set", "gram0", "gram1").mapInPandas(turn, schema).collect():
        name = keys[r["set"]][r["k"]]
        chosen, width = wanted[r["set"]][name], len(r["means"]) // 2
        axes = None if r["axes"] is None else np.array(r["axes"]).reshape(len(chosen), width)
        found[r["set"]][name] = Rotation(chosen, axes, np.array(r["means"]).reshape(2, width), np.array(r["within"]).reshape(width, width))
    return found


@dataclass
class Problem:
    """A penalised logistic fit on a set's rotated features: its weights, the intercept last, and where its search stands."""

    set: int
    rotation: tuple
    c: float
    l1: bool
    w: np.ndarray
    trial: np.ndarray = field(init=False)
    step: np.ndarray | None = None
    share: float = 1.0
    value: float = np.inf
    steps: int = 0
    done: bool = False

    def __post_init__(self):
        self.trial = self.w

    def met(self, value: float, step: np.ndarray) -> None:
        """Take the trial if it is no worse than where it came from, and try the next step; otherwise try half the step."""
        self.steps += 1
        if value <= self.value + 1e-12 * abs(value) or self.share < 1e-6:
            self.w, self.value, self.step, self.share = self.trial, value, step, 1.0
        else:
            self.share /= 2
        self.trial = self.w + self.share * self.step
        if np.abs(self.share * self.step).max() < TOLERANCE or self.steps >= STEPS:
            self.w, self.done = self.trial, True


def newton_step(w: np.ndarray, slope: np.ndarray, bend: np.ndarray, l1: bool) -> np.ndarray:
    """Where the quadratic model of the loss, with the penalty, is least; the intercept, the last weight, has no penalty."""
    bend = bend + 1e-10 * np.eye(len(w))
    if not l1:
        ridge = np.append(np.ones(len(w) - 1), 0.0)
        return -np.linalg.solve(bend + np.diag(ridge), slope + ridge * w)
    step, rest = np.zeros(len(w)), slope.copy()
    for _ in range(1000):
        largest = 0.0
        for k in range(len(w)):
            at = w[k] + step[k]
            free = at - rest[k] / bend[k, k]
            new = free if k == len(w) - 1 else np.sign(free) * max(abs(free) - 1 / bend[k, k], 0.0)
            if new != at:
                rest += bend[:, k] * (new - at)
                step[k] += new - at
                largest = max(largest, abs(new - at))
        if largest < TOLERANCE / 10:
            break
    return step


def penalty(w: np.ndarray, l1: bool) -> float:
    return float(np.abs(w[:-1]).sum() if l1 else (w[:-1] ** 2).sum() / 2)


def solve(rows: DataFrame, sets: int, preps: Mapping[int, Prepared], turned: Mapping[int, Mapping[tuple, Rotation]], problems: Sequence[Problem]) -> None:
    """Newton steps for all problems together until each of them stands still."""
    sc = rows.sparkSession.sparkContext
    while open_ := [k for k, p in enumerate(problems) if not p.done]:
        size = np.cumsum([8 * (len(problems[k].w) + 1) ** 2 for k in open_])
        now = [k for k, upto in zip(open_, size, strict=True) if upto <= PASS_BYTES] or open_[:1]
        state: dict[int, dict[tuple, list]] = {}
        for k in now:
            p = problems[k]
            state.setdefault(p.set, {}).setdefault(p.rotation, []).append((k, p.trial, p.c, p.l1))
        told = sc.broadcast((state, {s: preps[s] for s in state}, {s: {r: turned[s][r] for r in by} for s, by in state.items()}))

        def partial(pdf: pd.DataFrame, told=told) -> Iterator[tuple[int, np.ndarray]]:
            asked, prep, rotation = told.value
            if not len(pdf):
                return
            x, y, inside = features_of(pdf), pdf["_y"].to_numpy(int), members(pdf, "train", sets)
            for s, by in asked.items():
                own = inside[:, s]
                if not own.any():
                    continue
                z, label, weight = prep[s](x[own]), y[own], prep[s].weights(y[own])
                for name, fits in by.items():
                    a = np.hstack([rotation[s][name](z), np.ones((len(z), 1))])
                    for k, w, c, _ in fits:
                        at = a @ w
                        p = models.sigmoid(at)
                        loss = np.logaddexp(0, at) - label * at
                        slope = a.T @ (c * weight * (p - label))
                        bend = (a * (c * weight * p * (1 - p))[:, None]).T @ a
                        yield k, np.concatenate([[(c * weight * loss).sum()], slope, bend.ravel()])

        def finish(k: int, total: np.ndarray, told=told) -> tuple:
            w, l1 = next((w, l1) for by in told.value[0].values() for fits in by.values() for j, w, _, l1 in fits if j == k)
            d = len(w)
            return k, float(total[0]) + penalty(w, l1), newton_step(w, total[1 : d + 1], total[d + 1 :].reshape(d, d), l1)

        for r in summed(rows, partial, finish, "problem int, value double, step array<double>").collect():
            problems[r["problem"]].met(r["value"], np.array(r["step"]))
        told.unpersist()


def fourth_norms(rows: DataFrame, sets: int, preps: Mapping[int, Prepared], turned: Mapping[int, Mapping[tuple, Rotation]]) -> dict[tuple[int, tuple], float]:
    """By set and rotation the mean fourth power of the length of what is left of a row without its class mean, in deviations.

    The sum of all products of two squared components is the fourth power of the length, so
    the optimal shrinkage needs one number a rotation beside the second moments.
    """
    told = rows.sparkSession.sparkContext.broadcast((dict(preps), {s: dict(by) for s, by in turned.items()}))

    def partial(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        prep, by_set = told.value
        if not len(pdf):
            return
        x, y, inside = features_of(pdf), pdf["_y"].to_numpy(int), members(pdf, "train", sets)
        for s, by in by_set.items():
            own = inside[:, s]
            if own.any():
                z, label = prep[s](x[own]), y[own]
                yield s, np.array([((((r(z) - r.means[label]) / scale_of(r.within)) ** 2).sum(axis=1) ** 2).sum() for r in by.values()])

    names = {s: list(by) for s, by in turned.items()}
    found = summed(rows, partial, lambda s, total: (s, total), "set int, sums array<double>").collect()
    told.unpersist()
    return {(r["set"], name): v / sum(preps[r["set"]].sizes) for r in found for name, v in zip(names[r["set"]], r["sums"], strict=True)}


def scale_of(within: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(within).clip(0))
    return np.where(sd > 0, sd, 1.0)


def discriminant(rotation: Rotation, sizes: tuple[int, int], shrink: float | None, fourth: float | None = None) -> np.ndarray:
    """Linear discriminant weights, the intercept last, from class means and the scatter within classes; shrink None takes the optimal share (Ledoit and Wolf, 2004)."""
    n, d, scale = sum(sizes), rotation.width, scale_of(rotation.within)
    s = rotation.within / np.outer(scale, scale)
    if shrink is None:
        spread = ((s - np.trace(s) / d * np.eye(d)) ** 2).sum()
        shrink = float(np.clip((fourth - (s**2).sum()) / n / spread, 0.0, 1.0)) if spread > 0 else 0.0
    cov = ((1 - shrink) * s + shrink * np.trace(s) / d * np.eye(d)) * np.outer(scale, scale)
    m0, m1 = rotation.means
    w = np.linalg.lstsq(cov, m1 - m0, rcond=None)[0]
    return np.append(w, np.log(max(1, sizes[1]) / max(1, sizes[0])) - (m1 + m0) @ w / 2)


def whole_discriminant(df: DataFrame, vector: str, y: str, shrink: float | None = None) -> np.ndarray:
    """Linear discriminant weights of a table's features as they are, the intercept last, from two passes of sums; rows lack no feature."""
    rows = kept(df.select(F.col(vector).cast("array<double>").alias("_x"), F.col(y).cast("int").alias("_y"), F.array(F.lit(0)).alias("train")), "whole")

    def partial(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        x, label = features_of(pdf), pdf["_y"].to_numpy()
        for k in (0, 1):
            own = x[label == k]
            if len(own):
                a = np.hstack([own, np.ones((len(own), 1))])
                yield k, (a.T @ a).ravel()

    grams = {r["label"]: np.array(r["gram"]) for r in summed(rows, partial, lambda k, total: (k, total), "label int, gram array<double>").collect()}
    if set(grams) != {0, 1}:
        raise ValueError("a discriminant needs rows of both classes")
    both = [g.reshape(int(np.sqrt(len(g))), -1) for _, g in sorted(grams.items())]
    d, sizes = len(both[0]) - 1, tuple(int(round(g[-1, -1])) for g in both)
    means = np.stack([g[-1, :-1] / g[-1, -1] for g in both])
    within = sum(g[:-1, :-1] - np.outer(m, m) * g[-1, -1] for g, m in zip(both, means, strict=True)) / sum(sizes)
    as_they_are = Prepared(np.zeros(d), np.arange(d), np.zeros(d), np.ones(d), sizes)
    rotation = Rotation(np.arange(d), None, means, within)
    fourth = fourth_norms(rows, 1, {0: as_they_are}, {0: {"all": rotation}})[0, "all"] if shrink is None else None
    return discriminant(rotation, sizes, shrink, fourth)


@dataclass
class Fitted:
    """A candidate fitted to a set: preparation, rotation and the model's weights."""

    params: dict
    prep: Prepared
    rotation: Rotation
    w: np.ndarray

    @property
    def line(self) -> np.ndarray:
        """The score before the sigmoid as weights on the imputed features, the intercept last."""
        own = self.w[:-1] if self.rotation.axes is None else self.rotation.axes @ self.w[:-1]
        at = self.prep.kept[self.rotation.chosen]
        mean, std = self.prep.mean[self.rotation.chosen], self.prep.std[self.rotation.chosen]
        line = np.zeros(len(self.prep.median) + 1)
        np.add.at(line, at, own / std)
        line[-1] = self.w[-1] - (own * mean / std).sum()
        return line


def fitted(rows: DataFrame, sets: int, candidates: Callable[[int, int], Sequence[dict]]) -> dict[int, list[Fitted]]:
    """By set every candidate fitted to it; ``candidates`` gives those of a set and its number of kept features. Sets with one class are out.

    rows: _x, _y and train, the numbers below ``sets`` of the sets that a row trains; kept, as it is read once a step.
    """
    preps, grams = prepared(rows, sets)
    wanted = {s: list(candidates(s, len(p.kept))) for s, p in preps.items()}
    whole = {s: {("all", None): np.arange(len(p.kept))} for s, p in preps.items()}
    everything = {s: {name: Rotation(at, None, np.zeros((2, len(at))), np.zeros((len(at),) * 2)) for name, at in by.items()} for s, by in whole.items()}
    first = [Problem(s, ("all", None), c, True, np.zeros(len(preps[s].kept) + 1)) for s in preps for c in dict.fromkeys(p["c"] for p in wanted[s])]
    solve(rows, sets, preps, everything, first)
    ranking = {(p.set, p.c): models.top_features(p.w[:-1], len(p.w) - 1) for p in first}
    chosen = {s: {((p["c"], p["k"]), p["pca"]): ranking[s, p["c"]][: p["k"]] for p in ps} for s, ps in wanted.items()}
    turned = rotations(grams, chosen)
    at = lambda p: ((p["c"], p["k"]), p["pca"])
    asked = {(s, at(p), p["model"][1]) for s, ps in wanted.items() for p in ps if p["model"][0] == "lr"}
    problems = {a: Problem(a[0], a[1], a[2], False, np.zeros(turned[a[0]][a[1]].width + 1)) for a in sorted(asked, key=str)}
    solve(rows, sets, preps, turned, list(problems.values()))
    open_ = {s: {at(p): turned[s][at(p)] for p in ps if p["model"] == ("lda", None)} for s, ps in wanted.items()}
    fourth = fourth_norms(rows, sets, preps, {s: by for s, by in open_.items() if by}) if any(open_.values()) else {}

    def weights(s: int, p: dict) -> np.ndarray:
        name, strength = p["model"]
        return problems[s, at(p), strength].w if name == "lr" else discriminant(turned[s][at(p)], preps[s].sizes, strength, fourth.get((s, at(p))))

    return {s: [Fitted(p, preps[s], turned[s][at(p)], weights(s, p)) for p in ps] for s, ps in wanted.items()}


def scored(rows: DataFrame, found: Mapping[int, Sequence[Fitted]], key: str, column: str) -> DataFrame:
    """(set, position, key, y, score): every row scored by all candidates of the sets that ``column`` names, ``SLICE`` rows at a time."""
    lines = {s: np.stack([f.line for f in fs], axis=1) for s, fs in found.items() if fs}
    medians = {s: fs[0].prep.median for s, fs in found.items() if fs}
    told = rows.sparkSession.sparkContext.broadcast((lines, medians))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line, median = told.value
        for pdf in batches:
            for begin in range(0, len(pdf), SLICE):
                part = pdf.iloc[begin : begin + SLICE]
                x, inside = features_of(part), part[column].map(set)
                for s, w in line.items():
                    own = inside.map(lambda sets, s=s: s in sets).to_numpy(bool)
                    if own.any():
                        score = models.sigmoid(np.where(np.isnan(x[own]), median[s], x[own]) @ w[:-1] + w[-1])
                        n = w.shape[1]
                        yield pd.DataFrame({"set": s, "position": np.tile(np.arange(n), own.sum()), key: np.repeat(part[key].to_numpy()[own], n), "y": np.repeat(part["_y"].to_numpy()[own], n), "score": score.ravel()})

    return rows.mapInPandas(run, f"set int, position int, {key} {kind}, y int, score double")


#: Rows that are scored at a time, as each gives a row a candidate.
SLICE = 256


#: Held-out rows of a set whose scores a task may hold, eight bytes each, and parts that a set's candidates are dealt into.
RANKED, PARTS = 1 << 20, 16
#: Rows whose scores are packed at a time.
PACKED = 4096


def areas(rows: DataFrame, found: Mapping[int, Sequence[Fitted]], key: str, column: str) -> DataFrame:
    """(set, position, auc, ap) of all candidates on the rows of the sets that ``column`` names; null where a class is missing.

    Scores leave their tasks as arrays, negative for class 0, and are shuffled once. Sets with
    more than ``RANKED`` such rows have theirs ranked in ranges, so no task holds them.
    """
    sizes = {r["set"]: r["n"] for r in rows.select(F.explode(column).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = {s: fs for s, fs in found.items() if sizes.get(s, 0) > RANKED}
    small = {s: fs for s, fs in found.items() if s not in large and fs}
    lines = {s: np.stack([f.line for f in fs], axis=1) for s, fs in small.items()}
    told = rows.sparkSession.sparkContext.broadcast((lines, {s: fs[0].prep.median for s, fs in small.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line, median = told.value
        for pdf in batches:
            for begin in range(0, len(pdf), PACKED):
                part = pdf.iloc[begin : begin + PACKED]
                x, y, inside = features_of(part), part["_y"].to_numpy(int), part[column].map(set)
                for s, w in line.items():
                    own = inside.map(lambda sets, s=s: s in sets).to_numpy(bool)
                    if own.any():
                        score = models.sigmoid(np.where(np.isnan(x[own]), median[s], x[own]) @ w[:-1] + w[-1])
                        yield pd.DataFrame({"set": s, "position": np.arange(w.shape[1]), "v": list((score * np.where(y[own] == 1, 1.0, -1.0)[:, None]).T.copy())})

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (s, position), v in pdf.groupby(["set", "position"])["v"]:
            v = np.concatenate(v.to_numpy())
            y = (v > 0).astype(int)
            out.append((s, position, models.auc(y, abs(v)), models.average_precision(y, abs(v))))
        return pd.DataFrame(out, columns=["set", "position", "auc", "ap"])

    packed = rows.mapInPandas(run, "set int, position int, v array<double>")
    made = packed.groupBy("set", F.pmod("position", F.lit(PARTS)).alias("_part")).applyInPandas(ranked, "set int, position int, auc double, ap double")
    if large:
        made = made.unionByName(auc_ap(scored(rows, large, key, column), ["set", "position"], "y", "score"))
    return made
