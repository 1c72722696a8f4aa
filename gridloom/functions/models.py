"""Small models in numpy, for use inside grouped tasks and on aggregated moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def balanced_weights(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same sum."""
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - int(y.sum()))
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic_l2(x: np.ndarray, y: np.ndarray, c: float, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, that minimise |w|^2 / 2 + c * weighted log loss, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    weight, w = c * balanced_weights(y), np.zeros(a.shape[1])
    ridge = np.ones(a.shape[1])
    ridge[-1] = 0
    for _ in range(steps):
        p = sigmoid(a @ w)
        slope = a.T @ (weight * (p - y)) + ridge * w
        bend = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-10)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic_l1(x: np.ndarray, y: np.ndarray, c: float, steps: int = 500) -> np.ndarray:
    """Coefficients, the intercept last, that minimise |w|_1 + c * weighted log loss, by accelerated proximal steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    weight = c * balanced_weights(y)
    rate = 4 / max(1e-12, np.linalg.eigvalsh((a * weight[:, None]).T @ a)[-1])
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        u = v - rate * (a.T @ (weight * (sigmoid(a @ v) - y)))
        new = np.append(np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - rate, 0), u[-1])
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / s * (new - w)
        if np.abs(new - w).max() < 1e-8:
            w = new
            break
        w, t = new, s
    return w


def top_features(coef: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest absolute coefficients; of equal ones the later comes first."""
    return np.argsort(np.abs(coef), kind="stable")[::-1][:k]


def shrinkage(x: np.ndarray) -> float:
    """The weight of a scaled identity in a covariance estimate (Ledoit and Wolf, 2004)."""
    n, d = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / d
    spread = ((s - mu * np.eye(d)) ** 2).sum()
    noise = ((x**2).T @ (x**2) / n - s**2).sum() / n
    return float(min(1.0, max(0.0, noise / spread))) if spread > 0 else 0.0


def discriminant(x: np.ndarray, y: np.ndarray, shrink: float | None = None) -> np.ndarray:
    """Linear discriminant coefficients, the intercept last; shrink None takes the optimal weight. Features are standardised for the covariance."""
    means = np.stack([x[y == k].mean(axis=0) for k in (0, 1)])
    within = x - means[y.astype(int)]
    scale = np.where((sd := within.std(axis=0)) > 0, sd, 1.0)
    scaled = within / scale
    d = x.shape[1]
    s = scaled.T @ scaled / len(x)
    part = shrinkage(scaled) if shrink is None else shrink
    cov = ((1 - part) * s + part * np.trace(s) / d * np.eye(d)) * np.outer(scale, scale)
    w = np.linalg.lstsq(cov, means[1] - means[0], rcond=None)[0]
    prior = np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    return np.append(w, prior - (means[1] + means[0]) @ w / 2)


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """The share of pairs in order, ties half; nan for one class."""
    pos, neg = s[y == 1], np.sort(s[y == 0])
    if not len(pos) or not len(neg):
        return float("nan")
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2 * len(pos) * len(neg)))


def average_precision(y: np.ndarray, s: np.ndarray) -> float:
    if y.sum() in (0, len(y)):
        return float("nan")
    values, inverse = np.unique(-s, return_inverse=True)
    tp, n = np.bincount(inverse, y, len(values)), np.bincount(inverse, minlength=len(values))
    return float((tp / y.sum() * tp.cumsum() / n.cumsum()).sum())


class Preparation:
    """Median imputation, quasi-constant and correlation pruning, and z-scores, learned from training rows alone."""

    def __init__(self, x: np.ndarray, quasi: float = 0.95, correlated: float = 0.95):
        self.median = np.nan_to_num(np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T]))
        full = np.where(np.isnan(x), self.median, x)
        share = np.array([np.unique(c, return_counts=True)[1].max() / len(c) for c in full.T])
        kept = np.flatnonzero(share < quasi)
        if not len(kept):
            kept = np.array([full.var(axis=0).argmax()])
        self.kept = kept[independent(np.nan_to_num(np.corrcoef(full[:, kept], rowvar=False)).reshape(len(kept), len(kept)), correlated)]
        self.mean, sd = full[:, self.kept].mean(axis=0), full[:, self.kept].std(axis=0)
        self.std = np.where(sd > 0, sd, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.median, x)[:, self.kept] - self.mean) / self.std


def independent(correlation: np.ndarray, most: float) -> np.ndarray:
    """Places that aren't correlated with any earlier one, dropped ones included."""
    bad = (np.triu(np.abs(correlation), 1) > most).any(axis=0)
    kept = np.flatnonzero(~bad)
    return kept if len(kept) else np.array([0])


class Principal:
    """The fewest principal axes that reach a share of the variance."""

    def __init__(self, x: np.ndarray, share: float | None):
        self.mean, self.axes = x.mean(axis=0), None
        if share is not None:
            values, axes = np.linalg.eigh(np.atleast_2d(np.cov(x, rowvar=False)))
            order = values.argsort()[::-1]
            reached = np.cumsum(values[order]) / max(values.sum(), 1e-300)
            self.axes = axes[:, order[: int(np.searchsorted(reached, share - 1e-12)) + 1]]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x if self.axes is None else (x - self.mean) @ self.axes


class Bags(Sequence):
    """Some of the bags that lie one after another in rows, each scaled when it is asked for, so that no scaled copy of all is held."""

    def __init__(self, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray, mean: np.ndarray | None = None, std: np.ndarray | None = None):
        self.rows, self.begins, self.ends, self.mean, self.std = rows, begins, ends, mean, std

    def __len__(self) -> int:
        return len(self.begins)

    def __getitem__(self, k: int) -> np.ndarray:
        x = self.rows[self.begins[k] : self.ends[k]].astype(float)
        return x if self.mean is None else (x - self.mean) / self.std

    def of(self, places: np.ndarray) -> Bags:
        return Bags(self.rows, self.begins[places], self.ends[places], self.mean, self.std)

    def pieces(self, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, each bag's first row) of about ``most`` rows at a time."""
        ends, at = np.cumsum(self.ends - self.begins), 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield np.concatenate([self[k] for k in range(at, upto)]), np.append(0, ends[at : upto - 1] - (ends[at - 1] if at else 0)).astype(int)
            at = upto

    def scaled(self) -> Bags:
        """These bags by the mean and the deviation of their own rows."""
        n, total, square = int((self.ends - self.begins).sum()), 0.0, 0.0
        for rows, _ in self.pieces():
            total = np.add.reduce(rows, axis=0) + total
        mean = total / n
        for rows, _ in self.pieces():
            square = np.add.reduce((rows - mean) ** 2, axis=0) + square
        std = np.sqrt(square / n)
        return Bags(self.rows, self.begins, self.ends, mean, np.where(std < 1e-8, 1.0, std))


class MaxPool:
    """A bag classifier: two ReLU layers on each instance, the largest of each unit over the bag, and a linear output."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, np.sqrt(2 / n), (n, m)) for n, m in ((inputs, hidden), (hidden, hidden))] + [r.normal(0, np.sqrt(1 / hidden), (hidden, 1))]
        self.b = [np.zeros(hidden), np.zeros(hidden), np.zeros(1)]

    def instances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(0, x @ self.w[0] + self.b[0])
        return h, np.maximum(0, h @ self.w[1] + self.b[1])

    def score(self, bag: np.ndarray) -> float:
        return float(self.scores(bag, np.array([0]))[0])

    def scores(self, rows: np.ndarray, first: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Scores of bags that lie one after another in rows, each from its first row on; about ``most`` rows at a time."""
        ends, told, at = np.append(first[1:], len(rows)), [], 0
        while at < len(first):
            upto = max(at + 1, int(np.searchsorted(ends, first[at] + most, "right")))
            pooled = np.maximum.reduceat(self.instances(rows[first[at] : ends[upto - 1]])[1], first[at:upto] - first[at], axis=0)
            told.append(sigmoid(pooled @ self.w[2][:, 0] + self.b[2][0]))
            at = upto
        return np.concatenate(told) if told else np.zeros(0)

    def gradients(self, rows: np.ndarray, *told: np.ndarray | float) -> list[np.ndarray]:
        """The loss's gradients, summed over bags that lie one after another; of equal largest units a bag's first one counts.

        told: each bag's first row, its class and weight; for a single bag, class and weight alone.
        """
        first, y, weight = told if len(told) == 3 else (np.zeros(1, int), *map(np.atleast_1d, told))
        h, g = self.instances(rows)
        sizes = np.diff(np.append(first, len(rows)))
        pooled = np.maximum.reduceat(g, first, axis=0)
        largest = g == np.repeat(pooled, sizes, axis=0)
        top = np.minimum.reduceat(np.where(largest, np.arange(len(rows))[:, None], len(rows)), first, axis=0)
        slope = weight * (sigmoid(pooled @ self.w[2][:, 0] + self.b[2][0]) - y)
        dg = np.zeros_like(g)
        dg[top, np.arange(g.shape[1])] = slope[:, None] * self.w[2][:, 0]
        dg[g <= 0] = 0
        dh = (dg @ self.w[1].T) * (h > 0)
        return [rows.T @ dh, h.T @ dg, (pooled.T @ slope)[:, None], dh.sum(axis=0), dg.sum(axis=0), np.array([slope.sum()])]

    def fit(self, bags: Sequence[np.ndarray], y: np.ndarray, held: tuple[Sequence[np.ndarray], np.ndarray] | None = None, epochs: int = 120, batch: int = 16, rate: float = 1e-3, patience: int = 20, seed: int = 0) -> MaxPool:
        """Adam on weighted log loss, gradients summed over ``batch`` bags; the best held-out AUC is kept."""
        r, weight = np.random.default_rng(seed), balanced_weights(y)
        state, count, best, since = [(0.0, 0.0)] * 6, 0, (-1.0, None), 0
        begins = lambda bs: np.append(0, np.cumsum([len(b) for b in bs]))[:-1].astype(int)
        kept = (np.concatenate(held[0]), begins(held[0])) if held else None
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                some = [bags[k] for k in part]
                summed = self.gradients(np.concatenate(some), begins(some), y[part], weight[part])
                count += 1
                for k, (total, target) in enumerate(zip(summed, [*self.w, *self.b], strict=True)):
                    g = total / len(part)
                    m, v = 0.9 * state[k][0] + 0.1 * g, 0.999 * state[k][1] + 0.001 * g * g
                    state[k] = (m, v)
                    target -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8)
            if held:
                got = auc(held[1], self.scores(*kept))
                since = 0 if got > best[0] else since + 1
                if got > best[0]:
                    best = (got, [x.copy() for x in (*self.w, *self.b)])
                if since >= patience:
                    break
        if best[1]:
            self.w, self.b = best[1][:3], best[1][3:]
        return self
