"""Cluster queries (G18, G20 to G24) on vectors stacked into 4 x 8 x 8 volumes with an organ and three scores a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters
from ..session import spread
from .aggregates import rounded
from .grids import STACK, volumes
from .registry import Tables, query

SPACING, LEAST = (3.0, 0.5, 0.5), 0.6

HEAT = STACK + (
    ", heat as (select k, z, y, x, n, pow(y - 3.5::double, 2) + pow(x - 3.5::double, 2) <= 17 organ, 1 / (1 + exp(-6 * v)) cs,"
    " 1 / (1 + exp((x - 3.5::double) / 2 - 3 * v)) pz, 1 - 1 / (1 + exp((x - 3.5::double) / 2 - 3 * v)) tz from stack join deep using (k))"
)
PLACE = "k, z, y, x"


def heat(t: Tables, parts: int | None = None) -> DataFrame:
    """Cells with an organ, a round part of each layer, a score and the scores of two zones."""
    pz = 1 / (1 + F.exp((F.col("x") - 3.5) / 2 - 3 * F.col("v")))
    organ = F.pow(F.col("y") - 3.5, 2.0) + F.pow(F.col("x") - 3.5, 2.0) <= 17
    return volumes(t, parts).select("case", "z", "y", "x", organ.alias("organ"), (1 / (1 + F.exp(-6 * F.col("v")))).alias("cs"), pz.alias("pz"), (1 - pz).alias("tz"))


def smoothing_sql(column: str) -> str:
    """Three passes of a Gaussian over values and weights, the last cell of a line counting on beyond its end."""
    told, made = "n0", f", n0 as (select {PLACE}, n, organ, case when organ then {column} else 0 end num, organ::int::double den from heat)"
    for axis, sigma, end in (("z", 0.5, "p.n - 1"), ("y", 1.0, "7"), ("x", 1.0, "7")):
        kernel = clusters.gaussian(sigma)
        taps = ", ".join(f"({k - len(kernel) // 2}, {w!r}::double)" for k, w in enumerate(kernel))
        same = " and ".join(f"q.{a} = p.{a}" for a in ("k", "z", "y", "x") if a != axis)
        made += (
            f", n{axis} as (select p.k, p.z, p.y, p.x, p.n, p.organ, sum(w * q.num) num, sum(w * q.den) den from {told} p, (values {taps}) t(o, w), {told} q"
            f" where {same} and q.{axis} = greatest(0, least({end}, p.{axis} + o)) group by all)"
        )
        told = f"n{axis}"
    return made + f", smooth as (select {PLACE}, case when organ and den > 1e-6 then greatest(0, least(1, num / den)) else 0 end v from {told})"


def near(a: str, b: str, reach: tuple[int, int, int]) -> str:
    return f"{a}.k = {b}.k and " + " and ".join(f"abs({a}.{axis} - {b}.{axis}) <= {r}" for axis, r in zip("zyx", reach, strict=True))


def closing_sql(source: str, name: str, flat: bool) -> str:
    """Grown by a box inside the array, then cells whose whole box is in it: at the array's border none is."""
    reach = (0, 1, 1) if flat else (1, 1, 1)
    return (
        f", {name}_d as (select distinct s.k, s.z, s.y, s.x from heat s join {source} m on {near('s', 'm', reach)})"
        f", {name} as (select a.k, a.z, a.y, a.x from {name}_d a join {name}_d b on {near('a', 'b', reach)} join heat h on h.k = a.k and h.z = a.z and h.y = a.y and h.x = a.x and organ"
        f" group by all having count(*) = {9 if flat else 27})"
    )


def filling_sql(source: str, name: str) -> str:
    """With background that doesn't reach its layer's border by faces, inside the organ."""
    return (
        f", {name}_b as (select {PLACE} from heat where ({PLACE}) not in (select {PLACE} from {source}))"
        f", {name}_o(k, z, y, x) as (select {PLACE} from {name}_b where y in (0, 7) or x in (0, 7) union"
        f" select b.k, b.z, b.y, b.x from {name}_o o join {name}_b b on b.k = o.k and b.z = o.z and abs(b.y - o.y) + abs(b.x - o.x) = 1)"
        f", {name} as (select {PLACE} from heat where organ and ({PLACE}) not in (select {PLACE} from {name}_o))"
    )


def labels_sql(source: str, name: str) -> str:
    """Each cell with the first cell of all that it reaches by touching cells."""
    return (
        f", {name}_r(k, z, y, x, root) as (select {PLACE}, z * 64 + y * 8 + x from {source} union"
        f" select s.k, s.z, s.y, s.x, r.root from {name}_r r join {source} s on {near('s', 'r', (1, 1, 1))})"
        f", {name} as (select {PLACE}, min(root) root from {name}_r group by {PLACE})"
    )


RAW = f", raw as (select {PLACE} from heat where organ and cs >= {LEAST})"
CORE = ", core as (select distinct a.k, a.z, a.y, a.x from raw a join raw b on b.k = a.k and abs(b.z - a.z) = 1 and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1)"
CLUSTERS = RAW + CORE + closing_sql("core", "shut", True) + filling_sql("shut", "fill") + labels_sql("fill", "lab")


@query("g18_smoothing", f"with {HEAT}{smoothing_sql('cs')} select k as \"case\", z, y, x, round(v, 6) v from smooth")
def smoothing(t: Tables) -> DataFrame:
    return rounded(clusters.smoothed(heat(t), "cs", out="v").select("case", "z", "y", "x", "v"))


@query("g20_dilation", f"with {HEAT}{RAW} select distinct s.k as \"case\", s.z, s.y, s.x from heat s join raw m on {near('s', 'm', (1, 1, 1))}")
def dilation(t: Tables) -> DataFrame:
    return clusters.dilated(heat(t).withColumn("m", clusters.at_least("cs", LEAST)), "m").filter("m = 1").select("case", "z", "y", "x")


@query("g20_closing", f"with {HEAT}{RAW}{closing_sql('raw', 'shut', False)} select k as \"case\", z, y, x from shut")
def closing(t: Tables) -> DataFrame:
    return clusters.closed(heat(t).withColumn("m", clusters.at_least("cs", LEAST)), "m").filter("m = 1 and organ").select("case", "z", "y", "x")


@query("g20_hole_fill", f"with recursive {HEAT}, raw as (select {PLACE} from heat where organ and cs >= 0.5){filling_sql('raw', 'fill')} select k as \"case\", z, y, x from fill")
def hole_fill(t: Tables) -> DataFrame:
    return clusters.filled(heat(t).withColumn("m", clusters.at_least("cs", 0.5)), ["m"]).filter("m = 1").select("case", "z", "y", "x")


@query("g21_zone_continuity", f"""with recursive {HEAT}{RAW}{closing_sql('raw', 'shut', False)}{filling_sql('shut', 'fill')}{labels_sql('fill', 'lab')},
  c as (select k, root, count(*)::bigint n, count(distinct z)::bigint layers, avg(cs) mean, max(cs) mx, quantile_cont(cs, 0.9) p90 from lab join heat using ({PLACE}) group by 1, 2),
  b as (select *, row_number() over (partition by k order by n desc, root) r from c),
  w as (select k, count(*) filter (organ) organ from heat group by 1), a as (select k, count(*) n from raw group by 1), f as (select k, count(*) n from fill group by 1)
  select w.k as "case", coalesce(a.n, 0)::bigint raw_voxels, coalesce(f.n, 0)::bigint smoothed_voxels, greatest(coalesce(f.n, 0) - coalesce(a.n, 0), 0)::bigint filled_gap_voxels,
  coalesce(b.n, 0)::bigint largest_voxels, coalesce(layers, 0)::bigint largest_layers, coalesce(b.n, 0) * 0.75::double largest_mm3, round(coalesce(mean, 0), 6) largest_mean,
  round(coalesce(mx, 0), 6) largest_max, round(coalesce(p90, 0), 6) largest_p90, round(coalesce(f.n, 0)::double / greatest(1, organ), 6) smooth_density
  from w left join a using (k) left join f using (k) left join b on b.k = w.k and r = 1""")  # fmt: skip
def zone_continuity(t: Tables) -> DataFrame:
    return rounded(clusters.zone_continuity(heat(t), "cs", LEAST, SPACING))


_TOP = ", ".join(f"{f}({c}) filter (r <= {n}) top{n}_cluster_{name}" for f, c, name in (("avg", "score", "score_mean"), ("sum", "n", "voxels_total"), ("sum", "n * 0.75::double", "mm3_total")) for n in (2, 3))
_NAMES = {"score": "score", "voxels": "n", "mm3": "n * 0.75::double", "z_slices": "layers", "z_span_mm": "span * 3.0::double", "mean": "mean", "max": "mx", "p90": "p90", "top10_mean": "top10", "core_hot_voxels": "nc", "filled_gap_voxels": "n - nc", "core_mean": "coalesce(cm, mean)", "core_p90": "coalesce(cp, p90)"}
_COUNTS = ("raw_hot_voxels", "z_supported_hot_voxels", "z_unsupported_hot_voxels", "xy_filled_cluster_voxels", "xy_filled_gap_voxels", "raw_num_clusters", "valid_num_clusters", "ignored_small_clusters", "ignored_single_slice_clusters",
           "best_cluster_voxels", "best_cluster_z_slices", "best_cluster_core_hot_voxels", "best_cluster_filled_gap_voxels", "second_cluster_voxels", "top2_cluster_voxels_total", "top3_cluster_voxels_total")
_MEASURES = (
    *(f"best_cluster_{n}" for n in _NAMES if f"best_cluster_{n}" not in _COUNTS), "second_cluster_score", "best_minus_second_cluster_score", "dominance_ratio", "cluster_score_concentration",
    "top2_cluster_score_mean", "top3_cluster_score_mean", "top2_cluster_mm3_total", "top3_cluster_mm3_total", "dominant_first_weighted_score", "dominant_second_weighted_score", "dominant_first_ratio",
    "dominant_second_ratio", "dominant_zone_margin", "dominant_zone_entropy", "dominant_zone_is_uncertain", "dominant_first_mask_fraction", "dominant_second_mask_fraction",
)


@query("g22_dominant_cluster", f"""with recursive {HEAT}{CLUSTERS}
  , z0r as (select {PLACE} from heat where organ and pz >= 0.5){closing_sql('z0r', 'z0s', False)}{filling_sql('z0s', 'z0')}
  , z1r as (select {PLACE} from heat where organ and tz >= 0.5){closing_sql('z1r', 'z1s', False)}{filling_sql('z1s', 'z1')}
  , v as (select {PLACE}, root, cs, pz, tz, ({PLACE}) in (select {PLACE} from core) core, ({PLACE}) in (select {PLACE} from z0) m0, ({PLACE}) in (select {PLACE} from z1) m1 from lab join heat using ({PLACE})),
  o as (select *, row_number() over (partition by k, root order by cs desc) place, count(*) over (partition by k, root) size from v),
  c as (select k, root, count(*) n, count(*) filter (core) nc, count(distinct z) layers, max(z) - min(z) + 1 span, avg(cs) mean, max(cs) mx, quantile_cont(cs, 0.9) p90,
    avg(cs) filter (place <= greatest(1, ceil(size * 0.1::double))) top10, avg(cs) filter (core) cm, quantile_cont(cs, 0.9) filter (core) cp,
    sum(cs * pz) w0, sum(cs * tz) w1, count(*) filter (m0) n0, count(*) filter (m1) n1 from o group by 1, 2),
  s as (select *, 0.35 * coalesce(cm, mean) + 0.25 * coalesce(cp, p90) + 0.15 * top10 + 0.10 * mx + 0.08 * least(1, ln(1 + n::double) / ln(1001::double)) + 0.04 * least(1, layers / 5.0::double) + 0.03 * nc / n::double score from c),
  g as (select *, row_number() over (partition by k order by score desc, root) r from s),
  b as (select k, count(*) valid_num_clusters, {", ".join(f"max({sql}) filter (r = 1) best_cluster_{name}" for name, sql in _NAMES.items())}, coalesce(max(score) filter (r = 2), 0) second_cluster_score,
    coalesce(max(n) filter (r = 2), 0) second_cluster_voxels, max(score) filter (r = 1) - coalesce(max(score) filter (r = 2), 0) best_minus_second_cluster_score,
    max(score) filter (r = 1) / case when count(*) > 1 then greatest(max(score) filter (r = 2), 1e-12) else 1 end dominance_ratio, {_TOP}, max(score) filter (r = 1) / greatest(sum(score) filter (r <= 3), 1e-12) cluster_score_concentration from g group by 1),
  q as (select k, n, w0, w1, n0, n1, w0 + w1 > 1e-12 known, case when w0 + w1 > 1e-12 then w0 / (w0 + w1) else 0 end a, case when w0 + w1 > 1e-12 then w1 / (w0 + w1) else 0 end b from g where r = 1),
  d as (select k, w0 dominant_first_weighted_score, w1 dominant_second_weighted_score, a dominant_first_ratio, b dominant_second_ratio, abs(a - b) dominant_zone_margin,
    case when known then -(a * ln(greatest(a, 1e-12)) + b * ln(greatest(b, 1e-12))) else 0 end dominant_zone_entropy, case when not known then -1 when a >= 0.65 then 0 when b >= 0.65 then 1 else 0.5 end code,
    case when known and (a >= 0.65 or b >= 0.65) then 0 else 1 end dominant_zone_is_uncertain, n0 / n::double dominant_first_mask_fraction, n1 / n::double dominant_second_mask_fraction from q),
  e as (select k, (select count(*) from raw where raw.k = h.k) raw_hot_voxels, (select count(*) from core where core.k = h.k) z_supported_hot_voxels, (select count(*) from fill where fill.k = h.k) xy_filled_cluster_voxels,
    (select count(distinct root) from lab where lab.k = h.k) raw_num_clusters from deep h),
  w as (select *, raw_hot_voxels - z_supported_hot_voxels z_unsupported_hot_voxels, greatest(0, xy_filled_cluster_voxels - z_supported_hot_voxels) xy_filled_gap_voxels,
    0 ignored_small_clusters, (raw_hot_voxels > 0 and xy_filled_cluster_voxels = 0)::int ignored_single_slice_clusters from e)
  select w.k as "case", {", ".join(f"coalesce({n}, 0)::bigint {n}" for n in _COUNTS)}, {", ".join(f"round(coalesce({n}, 0)::double, 6) {n}" for n in _MEASURES)}, coalesce(code, -1)::double dominant_zone_label_code
  from w left join b using (k) left join d using (k)""")  # fmt: skip
def dominant_cluster(t: Tables) -> DataFrame:
    made = clusters.dominant_clusters(heat(t), "cs", "pz", "tz", LEAST, SPACING)
    return rounded(made.withColumns({n: F.col(n).cast("long") for n in _COUNTS}))


@query("g23_overlays", f"""with recursive {HEAT}{CLUSTERS},
  v as (select lab.*, cs, ({PLACE}) in (select {PLACE} from core) core from lab join heat using ({PLACE})),
  o as (select *, row_number() over (partition by k, root order by cs desc) place, count(*) over (partition by k, root) size from v),
  c as (select k, root, count(*) n, count(*) filter (core) nc, count(distinct z) layers, avg(cs) mean, max(cs) mx, quantile_cont(cs, 0.9) p90, avg(cs) filter (place <= greatest(1, ceil(size * 0.1::double))) top10,
    avg(cs) filter (core) cm, quantile_cont(cs, 0.9) filter (core) cp from o group by 1, 2),
  s as (select *, 0.35 * coalesce(cm, mean) + 0.25 * coalesce(cp, p90) + 0.15 * top10 + 0.10 * mx + 0.08 * least(1, ln(1 + n::double) / ln(1001::double)) + 0.04 * least(1, layers / 5.0::double) + 0.03 * nc / n::double score from c),
  b as (select k, root from s qualify row_number() over (partition by k order by score desc, root) = 1), t as (select {PLACE} from lab join b using (k, root)),
  m as (select {PLACE}, (({PLACE}) in (select {PLACE} from raw))::int raw_hot, (({PLACE}) in (select {PLACE} from core))::int z_supported_hot, (({PLACE}) in (select {PLACE} from fill))::int xy_filled,
    (({PLACE}) in (select {PLACE} from t))::int dominant_cluster from heat)
  select k as "case", z, y, x, raw_hot, z_supported_hot, raw_hot - z_supported_hot z_unsupported_hot, xy_filled, dominant_cluster, dominant_cluster * z_supported_hot dominant_core from m""")  # fmt: skip
def overlay_marks(t: Tables) -> DataFrame:
    made = clusters.overlays(heat(t), "cs", LEAST)
    return made.select("case", "z", "y", "x", "raw_hot", "z_supported_hot", "z_unsupported_hot", "xy_filled", "dominant_cluster", "dominant_core")


@query("g24_case_summary")
def case_summary(t: Tables) -> DataFrame:
    """The whole row: patches on every second cell of the organ, their maps raw and smoothed, hot spots, zones and clusters at three thresholds."""
    cells = heat(t, spread(t.spark))
    patches = cells.filter("organ and y % 2 = 1 and x % 2 = 1").select("case", "z", "y", "x", "cs", (1 - F.col("cs")).alias("non_cs"), "pz", "tz")
    return clusters.case_summary(cells.select("case", "z", "y", "x", "organ"), patches, (0, 1, 1), SPACING)
