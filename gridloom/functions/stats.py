"""Statistics as aggregate expressions; population moments, linear quantiles, nulls and non-finite values left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import finite

EPS = 1e-12


def quantile(x: Column, p: float) -> Column:
    return F.percentile(x, F.lit(p))


def between(low: Column, high: Column, part: Column) -> Column:
    """What lies a part of the way from low to high: the high end's product is rounded, the low end's is added to it in one step, as DuckDB's quantile_cont does; so values at a threshold fall on the same side."""
    whole = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, F.lit(1.0) - part, high * part).cast("double")
    return F.when(part > 0, whole).otherwise(low)


def middle(values: Column) -> Column:
    """The median of an array of a few values, nulls left out."""
    kept = F.array_sort(F.array_compact(values))
    n = F.size(kept)
    return F.when(n > 0, F.get(kept, F.floor((n - 1) / 2).cast("int")) * 0.5 + F.get(kept, F.floor(n / 2).cast("int")) * 0.5)


def moments15(c: Column, prefix: str = "") -> list[Column]:
    """mean, std, var, min, max, median, p10, p25, p75, p90, iqr, skew, kurt (not in excess), rms, energy."""
    x = finite(c)
    std, flat = F.stddev_pop(x), F.stddev_pop(x) <= EPS
    named = {
        "mean": F.avg(x), "std": std, "var": F.var_pop(x), "min": F.min(x), "max": F.max(x), "median": quantile(x, 0.5), "p10": quantile(x, 0.1), "p25": quantile(x, 0.25),
        "p75": quantile(x, 0.75), "p90": quantile(x, 0.9), "iqr": quantile(x, 0.75) - quantile(x, 0.25), "skew": F.when(flat, 0.0).otherwise(F.skewness(x)),
        "kurt": F.when(flat, 0.0).otherwise(F.kurtosis(x) + 3), "rms": F.sqrt(F.avg(x * x)), "energy": F.avg(x * x),
    }
    return [v.alias(f"{prefix}{k}") for k, v in named.items()]


def moments4(c: Column, prefix: str = "") -> list[Column]:
    """kurt, median, skew and var; where the variance vanishes, the median alone."""
    x = finite(c)
    flat = F.var_pop(x) < EPS
    return [
        F.when(flat, 0.0).otherwise(F.kurtosis(x) + 3).alias(f"{prefix}kurt"), quantile(x, 0.5).alias(f"{prefix}median"),
        F.when(flat, 0.0).otherwise(F.skewness(x)).alias(f"{prefix}skew"), F.when(flat, 0.0).otherwise(F.var_pop(x)).alias(f"{prefix}var"),
    ]


def icc2_1(a: Column, b: Column) -> Column:
    """Absolute agreement of two raters, two-way random effects, single rater; null below 3 rows or where undefined."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    n = F.count(x).cast("double")
    rows = 2 * F.var_pop((x + y) / 2) * n / (n - 1)
    columns = n * (F.avg(x) - F.avg(y)) * (F.avg(x) - F.avg(y)) / 2
    rest = (F.var_pop(x - y) * n / 2) / (n - 1)
    below = rows + rest + 2 * (columns - rest) / n
    return F.when((n >= 3) & (F.abs(below) >= EPS), (rows - rest) / below)


def smd(x: Column, y: Column) -> Column:
    """Standardised mean difference of class 1 against class 0; null below three of either or without spread."""
    one, zero = F.when(y == 1, x.cast("double")), F.when(y == 0, x.cast("double"))
    spread = F.sqrt((F.var_samp(one) + F.var_samp(zero)) / 2)
    return F.when((F.count(one) >= 3) & (F.count(zero) >= 3) & (spread > 0), (F.avg(one) - F.avg(zero)) / spread)


def bin_count(x: Column, low: float, high: float, closed: bool = False) -> Column:
    return F.count_if((x >= low) & ((x <= high) if closed else (x < high)))
