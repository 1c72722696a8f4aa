"""Keys, labels, numbers and parameter texts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing key, and spellings of the two labels.
NULL_KEYS = ("", "nan", "none", "null", "<na>", "na")
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")


def number(c: Column) -> Column:
    """A text as a double; what is no number is null."""
    return c.cast("string").try_cast("double")


def finite(c: Column) -> Column:
    """c without NaN and infinities."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def key(c: Column) -> Column:
    """A trimmed key; spellings of nothing are null."""
    text = F.trim(c.cast("string"))
    return F.when(F.lower(text).isin(*NULL_KEYS), None).otherwise(text)


def loose_key(c: Column) -> Column:
    """Letters and digits of a key alone, in lower case: what a leakage check compares."""
    return F.regexp_replace(F.lower(F.trim(c.cast("string"))), "[^a-z0-9]", "")


def flag(c: Column) -> Column:
    """1, 0 or null from the accepted spellings."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TRUE_WORDS), 1).when(text.isin(*FALSE_WORDS), 0)


def zone(c: Column) -> Column:
    text = F.upper(F.trim(c.cast("string")))
    return F.when(text.isin("PZ", "0"), "PZ").when(text.isin("TZ", "1"), "TZ")


def three_class(positive: Column, zoned: Column) -> Column:
    """FALSE, or TRUE with the zone; a positive without a zone is null."""
    return F.when(positive == 0, "FALSE").when((positive == 1) & zoned.isNotNull(), F.concat(F.lit("TRUE_"), zoned))


def threshold(task: Column) -> Column:
    return F.when(task == "zone", F.lit(0.45)).otherwise(F.lit(0.5))


def predicted(score: Column, task: Column) -> Column:
    return (score >= threshold(task)).cast("int")


def reasons(limits: Mapping[str, tuple[Column, float]]) -> Column:
    """Names of the ratios that are missing or under their limit, in the given order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(F.isnotnull(c) & ~F.isnan(c) & (c >= least), F.lit(False)), F.lit(name)) for name, (c, least) in limits.items())))


def by_rules(c: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The name of the first rule one of whose substrings the lower-cased text holds."""
    text = F.lower(c.cast("string"))
    out = None
    for name, parts in rules:
        hit = text.contains(parts[0])
        for p in parts[1:]:
            hit = hit | text.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other) if out is not None else F.lit(other)


#: Substrings by feature family, in the order in which they are tried.
FAMILIES = (
    ("cluster", ("cluster",)), ("hotspot", ("hotspot",)), ("smooth heat", ("smoothed_heatmap",)), ("heatmap", ("heatmap",)), ("cs-zone cross", ("_x_", "x_pz", "x_tz")),
    ("zone prob", ("pz_", "tz_")), ("threshold", ("count_ge", "frac_ge", "threshold")), ("patch stats", ("likelihood",)), ("patch count", ("n_patches",)),
)


def family(c: Column) -> Column:
    return by_rules(c, FAMILIES, "other")


#: What parts of feature names are shown as, in the order in which they are replaced.
SHORT = (
    ("_count_ge_threshold", " count ge thr"), ("_frac_ge_threshold", " frac ge thr"), ("_likelihood", ""), ("_smoothed_heatmap", " smooth"), ("_heatmap", " heat"),
    ("_dominant_cspca_cluster", " cluster"), ("_largest_hotspot", " hotspot"), ("_count_ge_", " ge"), ("_frac_ge_", " frac ge"), ("_top", " top"), ("_mean", " mean"), ("_std", " sd"),
    ("_median", " med"), ("_", " "),
)


def short_name(c: Column, most: int = 54) -> Column:
    """A feature's name for display: a leading scale as S1 to S3, known parts shortened, cut with a full stop where it is longer than ``most``."""
    text = F.regexp_replace(c.cast("string"), "^s([123])_", "S$1 ")
    for part, shown in SHORT:
        text = F.replace(text, F.lit(part), F.lit(shown))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit(".")))


def plain_name(c: Column) -> Column:
    """A file's or a table's name without its ending and its prefix."""
    return F.replace(F.replace(c.cast("string"), F.lit(".xlsx"), F.lit("")), F.lit("feature--"), F.lit(""))


def file_of(candidate: Column) -> Column:
    """The file of a candidate's id, its third part; an id of fewer parts is the file."""
    parts = F.split(candidate, r"\|\|")
    return plain_name(F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise(candidate))


def sorted_json(params: Column) -> Column:
    """A map as JSON with its keys in order; null or empty is {}."""
    entries = F.array_sort(F.map_entries(params))
    return F.when(params.isNull() | (F.size(params) == 0), "{}").otherwise(F.to_json(F.map_from_entries(entries)))


def share_key(c: Column) -> Column:
    """A variance share as its shortest text, or off."""
    return F.when(c.isNull() | F.isnan(c), "off").otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", ""))


def candidate_id(*parts: Column) -> Column:
    return F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def mean_std_text(mean: Column, std: Column, places: int = 4) -> Column:
    return F.concat_ws(" ± ", F.format_string(f"%.{places}f", mean), F.format_string(f"%.{places}f", std))


def text_mean_std(c: Column) -> Column:
    """The numbers of a mean ± std text."""
    parts = F.split(c, " ± ")
    return F.struct(number(F.get(parts, F.lit(0))).alias("mean"), number(F.get(parts, F.lit(1))).alias("std"))
