"""Texture maps of one volume in numpy: Laws, local statistics, Haralick, Gabor, gradients; and its surface.

Each works on what a grouped task holds, one case's volume. Borders are mirrored
with the border voxel repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import product

import numpy as np

from ..operators.grids import LAWS

EPS = 1e-12


@lru_cache(maxsize=256)
def mirrored(n: int, r: int) -> np.ndarray:
    """The places of n voxels with r mirrored ones at either end."""
    return np.pad(np.arange(n), r, mode="symmetric")


def along(x: np.ndarray, kernel: Sequence[float], axis: int) -> np.ndarray:
    """Correlation with a kernel along one axis."""
    n, axis = x.shape[axis], axis % x.ndim
    padded = x.take(mirrored(n, len(kernel) // 2), axis)
    at = (slice(None),) * axis
    return sum(c * padded[(*at, slice(k, k + n))] for k, c in enumerate(kernel))


#: Axes of at most so many voxels are filtered by one product with a matrix.
SHORT = 64


@lru_cache(maxsize=4096)
def mirrored_rows(kernel: bytes, kind: str, n: int) -> np.ndarray:
    """Correlation with a kernel along n voxels with mirrored borders, as a matrix."""
    k = np.frombuffer(kernel, kind)
    rows, places = np.zeros((n, n), kind), mirrored(n, len(k) // 2)
    for shift, c in enumerate(k):
        np.add.at(rows, (np.arange(n), places[shift : shift + n]), c)
    return rows


def filtered(x: np.ndarray, kernel: bytes, kind: str, axis: int) -> np.ndarray:
    """``along`` with a kernel's numbers as bytes, the axes in front of the last two all at once."""
    n = x.shape[axis]
    if n > SHORT:
        return along(x, np.frombuffer(kernel, kind), axis)
    rows = mirrored_rows(kernel, kind, n)
    if axis == x.ndim - 1:
        return x @ rows.T
    return (rows @ x.reshape(*x.shape[:axis], n, -1)).reshape(x.shape)


LAWS_BYTES = {name: np.array(kernel[::-1], float).tobytes() for name, kernel in LAWS.items()}


def laws(x: np.ndarray, code: str, held: dict | None = None) -> np.ndarray:
    """A separable filter: the code's first kernel runs along the first axis, and so on. Convolution turns kernels round.

    The last code's steps are kept in ``held``, so codes that begin alike share them.
    """
    steps = {} if held is None else held.setdefault("laws", {})
    for axis in range(x.ndim):
        name, part = code[2 * axis : 2 * axis + 2], code[: 2 * axis + 2]
        if axis not in steps or steps[axis][0] != part:
            steps[axis] = (part, filtered(x, LAWS_BYTES[name], "float", axis))
        x = steps[axis][1]
    return x


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """Each voxel's neighbourhood of that many voxels a side, along a last axis."""
    return windowed(x, size).reshape(*x.shape, -1)


def windowed(x: np.ndarray, size: int) -> np.ndarray:
    padded = np.pad(x, size // 2, mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(padded, (size,) * x.ndim)


LOCAL: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mean": lambda w: w.mean(axis=-1), "std": lambda w: w.std(axis=-1), "median": lambda w: np.median(w, axis=-1), "range": lambda w: w.max(axis=-1) - w.min(axis=-1),
}


#: Voxels of neighbourhoods that are held at a time.
HELD = 1 << 22


def local(x: np.ndarray, mask: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Every local statistic at the mask's voxels, whose windows are taken a few at a time."""
    view, places = windowed(x, size), np.nonzero(mask)
    step, told = max(1, HELD // size**x.ndim), {name: np.zeros(len(places[0])) for name in LOCAL}
    for begin in range(0, len(places[0]), step):
        some = tuple(p[begin : begin + step] for p in places)
        w = view[some].reshape(len(some[0]), -1)
        for name, f in LOCAL.items():
            told[name][begin : begin + step] = f(w)
    return told


def central(x: np.ndarray, axis: int) -> np.ndarray:
    """Central differences along an axis, one-sided at its ends; zeros along an axis of one voxel."""
    if x.shape[axis] < 2:
        return np.zeros_like(x)
    ahead = np.take(x, np.minimum(np.arange(x.shape[axis]) + 1, x.shape[axis] - 1), axis)
    behind = np.take(x, np.maximum(np.arange(x.shape[axis]) - 1, 0), axis)
    apart = np.full(x.shape[axis], 2.0)
    apart[[0, -1]] = 1.0
    return (ahead - behind) / apart.reshape([-1 if k == axis else 1 for k in range(x.ndim)])


def sobel(x: np.ndarray, axis: int) -> np.ndarray:
    for other in range(x.ndim):
        x = along(x, (-1, 0, 1) if other == axis else (1, 2, 1), other)
    return x


def gradients(x: np.ndarray) -> dict[str, np.ndarray]:
    """Differences by axis, their magnitude, Sobel responses by axis, and the response of each of these along each other axis."""
    axes = "zyx"[-x.ndim :]
    d = {f"d{a}": central(x, k) for k, a in enumerate(axes)}
    first = {f"sobel_{a}": sobel(x, k) for k, a in enumerate(axes)}
    mixed = {f"sobel_{a}{b}": sobel(first[f"sobel_{a}"], k) for a in axes for k, b in enumerate(axes) if a != b}
    return d | {"magnitude": np.sqrt(sum(v * v for v in d.values()))} | first | mixed


def gabor_parts(wavelength: float, azimuth: float, elevation: float, spacing: Sequence[float], bandwidth: float = 1.0) -> tuple[list[np.ndarray], float, float]:
    """(complex waves under a Gaussian along each axis, the mean of the real part of their product, its norm without that mean).

    Both the Gaussian and the wave are products of what they are along each axis, three deviations wide. Angles in radians, lengths in mm.
    """
    two = 2.0**bandwidth
    sigma = wavelength / np.pi * np.sqrt(np.log(2) / 2) * (two + 1) / (two - 1)
    turns = (np.sin(elevation), np.cos(elevation) * np.sin(azimuth), np.cos(elevation) * np.cos(azimuth))
    parts = []
    for s, turn in zip(spacing, turns, strict=True):
        r = max(1, int(np.ceil(3 * sigma / s)))
        at = np.arange(-r, r + 1) * s
        parts.append(np.exp(-at * at / (2 * sigma * sigma) + 2j * np.pi * turn * at / wavelength))
    whole = np.einsum("i,j,k->ijk", *parts).real
    return parts, float(whole.mean()), max(float(np.linalg.norm(whole - whole.mean())), EPS)


def gabor_kernel(wavelength: float, azimuth: float, elevation: float, spacing: Sequence[float], bandwidth: float = 1.0) -> np.ndarray:
    """A plane wave under a Gaussian, in mm, without a mean and of norm 1, three deviations wide along each axis. Angles in radians."""
    parts, mean, norm = gabor_parts(wavelength, azimuth, elevation, spacing, bandwidth)
    return (np.einsum("i,j,k->ijk", *parts).real - mean) / norm


@lru_cache(maxsize=1024)
def gabor_steps(wavelength: float, azimuth: float, elevation: float, spacing: tuple[float, ...]) -> tuple[list[bytes], list[bytes], float, float]:
    parts, mean, norm = gabor_parts(wavelength, azimuth, elevation, spacing)
    return [p[::-1].tobytes() for p in parts], [np.ones(len(p), complex).tobytes() for p in parts], mean, norm


def gabor(x: np.ndarray, spec: dict, spacing: Sequence[float], held: dict) -> np.ndarray:
    """A Gabor filter's response, an axis after another: the real part of the wave's response less the kernel's mean times the sum over its box."""
    parts, ones, mean, norm = gabor_steps(spec["wavelength"], spec["azimuth"], spec["elevation"], tuple(map(float, spacing)))

    def turned(kernels: list[bytes]) -> np.ndarray:
        # Filters of one elevation share the first step; the last one alone is kept.
        z = held.get("gabor")
        if z is None or z[0] != kernels[0]:
            held["gabor"] = z = (kernels[0], filtered(x, kernels[0], "complex", 0))
        return filtered(filtered(z[1], kernels[1], "complex", 1), kernels[2], "complex", 2)

    key = ("box", *map(len, ones))
    if key not in held:
        held[key] = turned(ones).real
    return (turned(parts).real - mean * held[key]) / norm


def convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution by Fourier transforms."""
    pads = [(n // 2, n // 2) for n in kernel.shape]
    padded = np.pad(x, pads, mode="symmetric")
    size = [a + b - 1 for a, b in zip(padded.shape, kernel.shape, strict=True)]
    axes = list(range(x.ndim))
    full = np.fft.irfftn(np.fft.rfftn(padded, size, axes) * np.fft.rfftn(kernel, size, axes), size, axes)
    return full[tuple(slice(k - 1, k - 1 + n) for k, n in zip(kernel.shape, x.shape, strict=True))]


def quantised(x: np.ndarray, levels: int) -> np.ndarray:
    low, high = x.min(), x.max()
    if high - low < EPS:
        return np.zeros(x.shape, np.int64)
    return np.clip(np.floor((x - low) / (high - low + EPS) * levels), 0, levels - 1).astype(np.int64)


#: The thirteen features, in this order.
HARALICK = ("asm", "contrast", "correlation", "difference_average", "homogeneity", "sum_average", "sum_variance", "sum_entropy", "entropy", "difference_variance", "difference_entropy", "imc1", "imc2")


def haralick(p: np.ndarray) -> np.ndarray:
    """Thirteen features of normalised co-occurrence matrices along the last two axes; entropies in nats."""
    n = p.shape[-1]
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    nats = lambda q, of: -(q * np.log(of + EPS))
    over = lambda q: q.sum(axis=(-2, -1))

    def centred(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(q.shape[-1])
        mean = (q * k).sum(-1)
        return mean, (q * (k - mean[..., None]) ** 2).sum(-1)

    px, py = p.sum(axis=-1), p.sum(axis=-2)
    (mx, vx), (my, vy) = centred(px), centred(py)
    flat = p.reshape(*p.shape[:-2], n * n)
    total = flat @ ((i + j).reshape(-1, 1) == np.arange(2 * n - 1)).astype(float)
    apart = flat @ (abs(i - j).reshape(-1, 1) == np.arange(n)).astype(float)
    (sum_mean, sum_var), (gap_mean, gap_var) = centred(total), centred(apart)
    entropy, outer = over(nats(p, p)), px[..., :, None] * py[..., None, :]
    hx, hy = nats(px, px).sum(-1), nats(py, py).sum(-1)
    correlation = (over(p * i * j) - mx * my) / (np.sqrt(vx + EPS) * np.sqrt(vy + EPS) + EPS)
    told = {
        "asm": over(p * p), "contrast": over(p * (i - j) ** 2), "correlation": correlation, "difference_average": gap_mean, "homogeneity": over(p / (1 + (i - j) ** 2)),
        "sum_average": sum_mean, "sum_variance": sum_var, "sum_entropy": nats(total, total).sum(-1), "entropy": entropy, "difference_variance": gap_var, "difference_entropy": nats(apart, apart).sum(-1),
        "imc1": (entropy - over(nats(p, outer))) / (np.maximum(hx, hy) + EPS), "imc2": np.sqrt(np.maximum(0, 1 - np.exp(-2 * (over(nats(outer, outer)) - entropy)))),
    }
    return np.stack([told[name] for name in HARALICK], axis=-1)


def box_sums(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over the window around each place of the first two axes, mirrored at the borders; by an integral image where an axis is long."""
    r = size // 2
    if max(x.shape[:2]) <= SHORT:
        one = np.ones(size).tobytes()
        rows, cols = (mirrored_rows(one, "float", n) for n in x.shape[:2])
        return cols @ (rows @ x.reshape(len(x), -1)).reshape(x.shape)
    padded = np.pad(x, [(r + 1, r), (r + 1, r), (0, 0)], mode="symmetric")
    padded[0], padded[:, 0] = 0, 0
    whole = padded.cumsum(axis=0).cumsum(axis=1)
    return whole[size:, size:] - whole[:-size, size:] - whole[size:, :-size] + whole[:-size, :-size]


def pair_counts(plane: np.ndarray, size: int, levels: int = 8, offsets: Sequence[tuple[int, int]] = ((0, 1), (1, 0), (1, 1), (1, -1))) -> np.ndarray:
    """How often each pair of levels stands in the window around each pixel.

    For each offset a pixel and the one the offset behind it make an ordered pair; a window
    counts its pixels' pairs, mirrored at the border of where the offset has pairs.
    """
    q = quantised(plane, levels)
    h, w = q.shape
    counts, one = np.zeros((h, w, levels * levels)), np.eye(levels * levels)
    for dy, dx in offsets:
        rows, cols = slice(max(0, dy), h + min(0, dy)), slice(max(0, dx), w + min(0, dx))
        if rows.stop > rows.start and cols.stop > cols.start:
            pair = q[rows, cols] * levels + q[rows.start - dy : rows.stop - dy, cols.start - dx : cols.stop - dx]
            counts[rows, cols] += box_sums(one[pair], size)
    return counts


def shares(counts: np.ndarray) -> np.ndarray:
    levels = int(np.sqrt(counts.shape[-1]))
    counts = counts.reshape(*counts.shape[:-1], levels, levels)
    return counts / (counts.sum(axis=(-2, -1), keepdims=True) + EPS)


def haralick_maps(plane: np.ndarray, size: int, levels: int = 8) -> np.ndarray:
    """The thirteen features of the window around each pixel."""
    return haralick(shares(pair_counts(plane, size, levels)))


def haralick_volume(x: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """The maps of each slice, zero outside the mask."""
    out = np.zeros((*x.shape, len(HARALICK)))
    out[mask] = haralick_at(x, mask, size)
    return out


def haralick_at(x: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """The features at each slice's masked pixels, from the box of its mask and half a window around it, which also sets its grey levels; one row a voxel of the mask."""
    told, held = [np.zeros((0, len(HARALICK)))], []
    for k in np.flatnonzero(mask.any(axis=(1, 2))):
        box = tuple(slice(max(0, int(at.min()) - size // 2), int(at.max()) + size // 2 + 1) for at in np.nonzero(mask[k]))
        held.append(pair_counts(x[(k, *box)], size)[mask[(k, *box)]])
        if sum(map(len, held)) > HELD // 1024:
            told.append(haralick(shares(np.concatenate(held))))
            held = []
    if held:
        told.append(haralick(shares(np.concatenate(held))))
    return np.concatenate(told)


def euler(mask: np.ndarray) -> int:
    """Corners minus edges plus faces minus voxels of the closed voxels, which joins voxels at corners."""
    padded, total = np.pad(mask.astype(bool), 1), 0
    for dims in product((0, 1), repeat=mask.ndim):
        part = padded
        for axis, whole in enumerate(dims):
            if not whole:
                part = np.take(part, range(part.shape[axis] - 1), axis) | np.take(part, range(1, part.shape[axis]), axis)
        total += (-1) ** sum(dims) * int(part.sum())
    return total


def surface(mask: np.ndarray, spacing: Sequence[float]) -> float:
    """The area of the surface at one half, by tetrahedra: each cube of eight voxel centres is cut into six, and each crossing gives a triangle or two."""
    x = np.pad(mask.astype(np.float64), 1)
    corners = np.array(list(product((0, 1), repeat=3)))
    base = np.stack(np.meshgrid(*(np.arange(n - 1) for n in x.shape), indexing="ij"), -1).reshape(-1, 3)
    values = np.stack([x[tuple((base + c).T)] for c in corners], axis=1)
    base, values = base[(lo := values.min(1)) < values.max(1)], values[lo < values.max(1)]
    paths = [(0, a, a + b, 7) for a in (1, 2, 4) for b in (1, 2, 4) if a != b]
    scale, area = np.asarray(spacing, np.float64), 0.0
    for tet in paths:
        v, p = values[:, tet], (base[:, None] + corners[list(tet)]) * scale
        inside = v > 0.5
        for count in (1, 2, 3):
            rows = np.flatnonzero(inside.sum(1) == count)
            if not len(rows):
                continue
            order = np.argsort(~inside[rows], axis=1, kind="stable")
            q, u = np.take_along_axis(p[rows], order[..., None], 1), np.take_along_axis(v[rows], order, 1)
            cut = lambda a, b: q[:, a] + (q[:, b] - q[:, a]) * ((0.5 - u[:, a]) / (u[:, b] - u[:, a]))[:, None]  # noqa: B023, E731
            triangle = lambda a, b, c: np.linalg.norm(np.cross(b - a, c - a), axis=1).sum() / 2
            if count == 2:
                a, b, c, d = cut(0, 2), cut(0, 3), cut(1, 3), cut(1, 2)
                area += triangle(a, b, c) + triangle(a, c, d)
            else:
                edges = [(0, 1), (0, 2), (0, 3)] if count == 1 else [(0, 3), (1, 3), (2, 3)]
                area += triangle(*(cut(a, b) for a, b in edges))
    return float(area)


#: Wavelengths of the Gabor filters, in mm.
WAVELENGTHS = (0.880, 1.482, 2.075, 2.668, 3.261)


def catalogue() -> list[dict]:
    """The maps of a full run, by rule: filter family, parameters and a name each."""
    five = [a + b + c for a, b, c in product(("L5", "E5", "S5", "W5", "R5"), repeat=3)]
    three = [a + b + c for a, b, c in product(("L3", "E3", "S3"), repeat=3)]
    angles = [round(k * np.pi / 8, 3) for k in range(8)]
    specs = [{"family": "laws", "code": c} for c in (*five, *three)]
    specs += [{"family": "haralick", "feature": f, "size": w} for w in (3, 5, 7, 9, 11) for f in HARALICK]
    specs += [{"family": "gray", "statistic": s, "size": w} for s in LOCAL for w in (3, 5, 7, 9, 11)]
    specs += [{"family": "gradient", "map": m} for m in ("dz", "dy", "dx", "magnitude", "sobel_z", "sobel_y", "sobel_x", "sobel_zy", "sobel_zx", "sobel_yz", "sobel_yx", "sobel_xz", "sobel_xy")]
    specs += [{"family": "gabor", "azimuth": a, "elevation": e, "wavelength": w} for a in angles for e in angles[::2] for w in WAVELENGTHS]
    return [s | {"name": "_".join(map(str, s.values()))} for s in specs]


def texture_map(x: np.ndarray, mask: np.ndarray, spec: dict, spacing: Sequence[float], held: dict) -> np.ndarray:
    """One map of a volume at its mask's voxels; what several maps share is worked out once and kept in ``held``."""
    kind = spec["family"]
    if kind == "laws":
        return laws(x, spec["code"], held)[mask]
    if kind == "gradient":
        if "gradient" not in held:
            held["gradient"] = gradients(x)
        return held["gradient"][spec["map"]][mask]
    if kind == "gabor":
        return gabor(x, spec, spacing, held)[mask]
    key = (kind, spec["size"])
    if key not in held:
        held[key] = local(x, mask, spec["size"]) if kind == "gray" else haralick_at(x, mask, spec["size"])
    return held[key][spec["statistic"]] if kind == "gray" else held[key][:, HARALICK.index(spec["feature"])]


def fours(maps: np.ndarray) -> np.ndarray:
    """``four`` of every row of a table of maps, those without an infinite or missing value all at once."""
    told = np.full((len(maps), 4), np.nan)
    whole = np.isfinite(maps).all(axis=1) if maps.shape[1] else np.zeros(len(maps), bool)
    for k in np.flatnonzero(~whole):
        told[k] = four(maps[k])
    v = np.ascontiguousarray(maps[whole])
    if len(v):
        d, var = v - v.mean(axis=1, keepdims=True), v.var(axis=1)
        flat = var < EPS
        over = np.where(flat, 1.0, var)
        square = d * d
        kurt, skew = (square * square).mean(axis=1) / over**2, (square * d).mean(axis=1) / over**1.5
        told[whole] = np.stack([np.where(flat, 0.0, kurt), np.median(v, axis=1), np.where(flat, 0.0, skew), np.where(flat, 0.0, var)], axis=1)
    return told


def four(v: np.ndarray) -> tuple[float, float, float, float]:
    """kurt, median, skew and var; the median alone where the variance vanishes, and NaN without finite values."""
    v = v[np.isfinite(v)]
    if not len(v):
        return np.nan, np.nan, np.nan, np.nan
    d, var = v - v.mean(), v.var()
    if var < EPS:
        return 0.0, float(np.median(v)), 0.0, 0.0
    return float((d**4).mean() / var**2), float(np.median(v)), float((d**3).mean() / var**1.5), float(var)
