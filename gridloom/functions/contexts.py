"""Features of patches and of the ring around them in numpy: many centres at once, each with the box of cells that its context covers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

EPS = 1e-12
LEVELS = 16
FIFTEEN = ("mean", "std", "var", "min", "max", "median", "p10", "p25", "p75", "p90", "iqr", "skew", "kurt", "rms", "energy")
TEXTURE = ("contrast", "dissimilarity", "homogeneity", "asm", "energy", "entropy", "correlation")


def offsets(reach: Sequence[int]) -> np.ndarray:
    """The cells of a box around its centre, in order."""
    return np.stack(np.meshgrid(*(np.arange(-r, r + 1) for r in reach), indexing="ij"), axis=-1).reshape(-1, len(reach))


def boxes(at: np.ndarray, values: np.ndarray, null: np.ndarray, centres: np.ndarray, radius: Sequence[int], outer: Sequence[int]) -> tuple[np.ndarray, ...]:
    """(centres that have a cell in their core; by centre, modality and cell of the box, the values and which are missing; by centre and cell, which are there).

    at: places of a case's cells; values and null: a column a modality.
    """
    low, high = at.min(axis=0), at.max(axis=0)
    centres = centres[((centres >= low - radius) & (centres <= high + radius)).all(axis=1)]
    pad = np.add(radius, outer)
    shape = high - low + 1 + 2 * pad
    place = np.ravel_multi_index(tuple((at - low + pad).T), shape)
    there = np.zeros(int(np.prod(shape)), bool)
    dense, gone = np.full((values.shape[1], len(there)), np.nan), np.zeros((values.shape[1], len(there)), bool)
    there[place], dense[:, place], gone[:, place] = True, values.T, null.T
    around = offsets(outer)
    steps = around @ np.append(np.cumprod(shape[::-1])[-2::-1], 1)
    cells = np.ravel_multi_index(tuple((centres - low + pad).T), shape)[:, None] + steps
    some = (there[cells] & (np.abs(around) <= radius).all(axis=1)).any(axis=1)
    cells = cells[some]
    return centres[some], dense[:, cells].transpose(1, 0, 2), gone[:, cells].transpose(1, 0, 2), there[cells]


def fifteen(v: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
    """Fifteen statistics of each row's own finite values; nan without any. Values are taken from the row's least, so equal ones have no spread."""
    own = own & np.isfinite(v)
    n = own.sum(axis=1)
    some = np.where(n > 0, n, np.nan)
    ranked = np.sort(np.where(own, v, np.inf), axis=1)
    rows, last = np.arange(len(v)), np.maximum(n - 1, 0)
    low = np.where(n > 0, ranked[:, 0], np.nan)
    d = np.where(own, v - low[:, None], 0.0)
    mean = d.sum(axis=1) / some
    d = np.where(own, d - mean[:, None], 0.0)
    square = d * d
    var = square.sum(axis=1) / some
    std = np.sqrt(var)

    def quantile(p: float) -> np.ndarray:
        place = last * p
        below, above = np.floor(place), np.ceil(place)
        a, b = ranked[rows, below.astype(int)], ranked[rows, above.astype(int)]
        return np.where(n == 0, np.nan, np.where(a == b, a, (above - place) * a + (place - below) * b + np.where(above == below, a, 0.0)))

    q = {p: quantile(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    flat = std <= EPS
    power = lambda k, w: np.where(flat, 0.0, (square * w).sum(axis=1) / some / np.where(flat, 1.0, std) ** k)
    energy = np.where(own, v * v, 0.0).sum(axis=1) / some
    found = (low + mean, std, var, low, np.where(n > 0, ranked[rows, last], np.nan), q[0.5], q[0.1], q[0.25], q[0.75], q[0.9], q[0.75] - q[0.25], power(3, d), power(4, square), np.sqrt(energy), energy)
    return dict(zip(FIFTEEN, found, strict=True))


def beside(a: np.ndarray, axis: int, step: int, empty: float) -> np.ndarray:
    """Each cell's neighbour along an axis."""
    out = np.full_like(a, empty)
    to, of = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    to[axis], of[axis] = (slice(1, None), slice(None, -1)) if step < 0 else (slice(None, -1), slice(1, None))
    out[tuple(to)] = a[tuple(of)]
    return out


def gradient(v: np.ndarray, there: np.ndarray, null: np.ndarray) -> np.ndarray:
    """The gradient's magnitude by central differences inside a patch, one-sided at its ends, 0 along an axis of one cell; nan where a patch is one cell high or wide."""
    total, lost, known = np.zeros(v.shape), np.zeros(v.shape, bool), there & ~null
    for axis in (1, 2, 3):
        before, after = beside(v, axis, -1, 0.0), beside(v, axis, 1, 0.0)
        has_before, has_after = beside(known, axis, -1, False), beside(known, axis, 1, False)
        d = np.where(has_after, after, v) - np.where(has_before, before, v)
        d[has_before & has_after] /= 2
        d[~has_before & ~has_after] = 0.0
        lost |= null & (has_before ^ has_after)
        total += d * d
    wide = [there.any(axis=tuple({1, 2, 3} - {axis})).sum(axis=1) > 1 for axis in (2, 3)]
    return np.where(lost | ~(wide[0] & wide[1])[:, None, None, None], np.nan, np.sqrt(total))


def middle_layer(v: np.ndarray, there: np.ndarray, inside: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, cells, missing values) of each patch's middle layer in the box of its own cells; the others there get the median of the own ones."""
    layers = there.any(axis=(2, 3))
    low = layers.argmax(axis=1)
    high = layers.shape[1] - 1 - layers[:, ::-1].argmax(axis=1)
    rows, at = np.arange(len(v)), low + (high - low + 1) // 2
    v, there, own, null = v[rows, at], there[rows, at], inside[rows, at], null[rows, at]
    box = there.copy()
    for axis in (1, 2):
        line = own.any(axis=3 - axis)
        k = np.arange(line.shape[1])
        reach = (k >= line.argmax(axis=1)[:, None]) & (k <= (line.shape[1] - 1 - line[:, ::-1].argmax(axis=1))[:, None]) & line.any(axis=1)[:, None]
        box &= np.expand_dims(reach, 3 - axis)
    finite = own & np.isfinite(v)
    n = finite.sum(axis=(1, 2))
    ranked = np.sort(np.where(finite, v, np.inf).reshape(len(v), -1), axis=1)
    last = np.maximum(n - 1, 0)
    a, b = ranked[rows, last // 2], ranked[rows, (last + 1) // 2]
    fill = np.where(n == 0, 0.0, np.where(a == b, a, 0.5 * a + 0.5 * b))
    return np.where(own, v, fill[:, None, None]), box, own & null


def texture(v: np.ndarray, there: np.ndarray, inside: np.ndarray, null: np.ndarray) -> dict[str, np.ndarray]:
    """The seven co-occurrence features of each patch's middle layer, symmetric and over four directions; nan without a pair of cells."""
    v, box, null = middle_layer(v, there, inside, null)
    known = box & ~null
    low, high = np.where(known, v, np.inf).min(axis=(1, 2)), np.where(known, v, -np.inf).max(axis=(1, 2))
    sound = np.where(known, np.isfinite(v), True).all(axis=(1, 2))
    low, high = np.where(sound, low, 0.0), np.where(sound, high, 0.0)
    none = ~known.any(axis=(1, 2))
    spread = np.where(none, 0.0, high - low)
    q = np.clip(np.floor(np.where(known, v - np.where(none, 0.0, low)[:, None, None], 0.0) / (spread + EPS)[:, None, None] * LEVELS), 0, LEVELS - 1)
    # Values that aren't finite leave no scale; a missing one counts as the highest level.
    q = np.where(null & ((spread >= EPS) | none | ~sound)[:, None, None], LEVELS - 1, np.where((spread < EPS)[:, None, None] | ~sound[:, None, None], 0, q)).astype(np.int64)
    found = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        h, w = q.shape[1:]
        one, other = (slice(None), slice(0, h - dy), slice(max(0, -dx), w - max(0, dx))), (slice(None), slice(dy, h), slice(max(0, dx), w + min(0, dx)))
        both = box[one] & box[other]
        a, b = q[one][both], q[other][both]
        found.append((np.nonzero(both)[0] * LEVELS + np.minimum(a, b)) * LEVELS + np.maximum(a, b))
    n = np.bincount(np.concatenate(found), minlength=len(v) * LEVELS * LEVELS).reshape(len(v), LEVELS, LEVELS)
    row, i, j = np.nonzero(n)
    pairs = n.sum(axis=(1, 2))
    p = n[row, i, j] / pairs[row]
    d = j - i
    half = np.where(d == 0, p, p / 2)
    total = lambda x: np.where(pairs > 0, np.bincount(row, x, len(v)), np.nan)
    m, asm = total(p * (i + j) / 2), total(half * half * np.where(d == 0, 1, 2))
    s = np.maximum(total(p * (i * i + j * j) / 2) - m * m, 0.0) + EPS
    made = (total(p * d * d), total(p * d), total(p / (1 + d)), asm, np.sqrt(asm), -total(p * np.log(half)), (total(p * i * j) - m * m) / (s + EPS))
    return dict(zip(TEXTURE, made, strict=True))


def features(v: np.ndarray, null: np.ndarray, there: np.ndarray, radius: Sequence[int], outer: Sequence[int]) -> tuple[list[dict[str, np.ndarray]], np.ndarray]:
    """(for each modality's core and ring, one after another, 37 features by centre; the correlation of the first two modalities' cores); nan where there is none.

    v and null: values and which are missing, by centre, modality and cell of the box; there: which cells are in the array.
    """
    count, modalities, cells = v.shape
    core = (np.abs(offsets(outer)) <= radius).all(axis=1)
    shape = (-1, *(2 * r + 1 for r in outer))
    whole, inner = there & core, there & ~core
    stack = lambda *parts: np.concatenate(parts * modalities)
    values = np.repeat(v.transpose(1, 0, 2), 2, axis=0).reshape(-1, cells)
    nulls = np.repeat(null.transpose(1, 0, 2), 2, axis=0).reshape(-1, cells)
    held, inside = stack(whole, there), stack(whole, inner)
    deep = [x.reshape(shape) for x in (values, held, nulls)]
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        told = fifteen(values, inside)
        told |= {f"grad_{k}": x for k, x in fifteen(gradient(*deep).reshape(values.shape), inside).items()}
        told |= {f"glcm_{k}": x for k, x in texture(deep[0], deep[1], inside.reshape(shape), deep[2]).items()}
        both = whole & np.isfinite(v[:, :2]).all(axis=1)
        n = both.sum(axis=1)
        least = np.where(both[:, None], v[:, :2], np.inf).min(axis=2, keepdims=True)
        d = np.where(both[:, None], v[:, :2] - least, 0.0)
        d = np.where(both[:, None], d - d.sum(axis=2, keepdims=True) / np.maximum(n, 1)[:, None, None], 0.0)
        square = (d * d).sum(axis=2)
        varies = (n >= 3) & (np.sqrt(square / np.maximum(n, 1)[:, None]) > EPS).all(axis=1)
        corr = np.where(varies, (d[:, 0] * d[:, 1]).sum(axis=1) / np.sqrt(square[:, 0] * square[:, 1]), 0.0)
    return [{k: x[part * count : (part + 1) * count] for k, x in told.items()} for part in range(2 * modalities)], corr
