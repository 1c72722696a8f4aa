"""Grid queries (G02 to G22, A24 to A27, W11) on 64-component vectors read as 8 x 8 grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import grids
from ..operators.contexts import context_features
from ..session import spread
from .aggregates import rounded
from .registry import Tables, query

CELLS = "cells as (select vec_id c, ((i - 1) // 8)::int y, ((i - 1) % 8)::int x, embedding[i]::double v from embeddings, range(1, 65) r(i))"
HOT = CELLS + ", hot as (select * from cells where v > 0.1)"


def images(t: Tables) -> DataFrame:
    return grids.cells(t.embeddings, "vec_id", "embedding", 8)


def hot(t: Tables, least: float = 0.1) -> DataFrame:
    return images(t).filter(F.col("v") > least)


@query("s09_voxel_view", f"with {CELLS} select c as \"case\", y, x, v from cells")
def voxel_view(t: Tables) -> DataFrame:
    return images(t)


@query("g02_centred_crop", f"""with {CELLS}, p as (select c, arg_max(y, row(v, -y, -x)) cy, arg_max(x, row(v, -y, -x)) cx from cells group by 1), g as (select (i // 5)::int y, (i % 5)::int x from range(25) r(i))
  select p.c as "case", g.y, g.x, coalesce(k.v, 0) v from p cross join g left join cells k on k.c = p.c and k.y = g.y + cy - 2 and k.x = g.x + cx - 2""")
def centred_crop(t: Tables) -> DataFrame:
    key = F.struct("v", -F.col("y"), -F.col("x"))
    centre = images(t).groupBy("case").agg(F.max_by("y", key).alias("cy"), F.max_by("x", key).alias("cx"))
    return grids.centred_crop(images(t), centre, 5, 5)


@query("g03_bounding_box", f"with {HOT} select c as \"case\", greatest(min(y) - 1, 0)::int y0, least(max(y) + 1, 7)::int y1, greatest(min(x) - 1, 0)::int x0, least(max(x) + 1, 7)::int x1 from hot group by 1")
def bounding_box(t: Tables) -> DataFrame:
    return grids.bounding_box(hot(t), margin=1, shape={"y": 8, "x": 8})


QUANT = CELLS + ", e as (select c, min(v) lo, max(v) hi from cells group by 1), q as (select cells.*, case when hi - lo < 1e-12 then 0 else least(greatest(floor((v - lo) / (hi - lo + 1e-12) * 16), 0), 15) end::int q from cells join e using (c))"


@query("g07_quantise", f"with {QUANT} select c as \"case\", y, x, q from q")
def quantise(t: Tables) -> DataFrame:
    return grids.quantised(images(t), 16).select("case", "y", "x", "q")


@query("g08_glcm", f"""with {QUANT}, o as (select a.c, a.q i, b.q j from q a join q b on a.c = b.c and ((b.y = a.y and b.x = a.x + 1) or (b.y = a.y + 1 and b.x in (a.x, a.x + 1, a.x - 1)))),
  s as (select c, i, j from o union all select c, j, i from o), n as (select c, i, j, count(*) n from s group by all), p as (select *, n / (sum(n) over (partition by c))::double p from n),
  m as (select c, sum(p * (i - j) * (i - j)) contrast, sum(p * abs(i - j)) dissimilarity, sum(p / (1 + abs(i - j))) homogeneity, sum(p * p) asm_, -sum(p * ln(p)) entropy, sum(p * i) mu, sum(p * i * i) s2, sum(p * i * j) ij from p group by 1)
  select c as "case", round(contrast, 6) contrast, round(dissimilarity, 6) dissimilarity, round(homogeneity, 6) homogeneity, round(asm_, 6) asm, round(sqrt(asm_), 6) energy, round(entropy, 6) entropy,
  round((ij - mu * mu) / (s2 - mu * mu), 6) correlation from m""")
def glcm(t: Tables) -> DataFrame:
    return rounded(grids.glcm(grids.quantised(images(t), 16)))


@query("g11_gradient", f"""with {CELLS}, d as (select *, lag(v) over (partition by c, x order by y) a, lead(v) over (partition by c, x order by y) b, lag(v) over (partition by c, y order by x) l, lead(v) over (partition by c, y order by x) r from cells),
  g as (select c, y, x, case when a is null then b - v when b is null then v - a else (b - a) / 2 end dy, case when l is null then r - v when r is null then v - l else (r - l) / 2 end dx from d)
  select c as "case", y, x, round(dy, 6) dy, round(dx, 6) dx, round(sqrt(dy * dy + dx * dx), 6) magnitude from g""")
def gradient(t: Tables) -> DataFrame:
    return rounded(grids.gradient(images(t)).drop("v"))


NEAR = CELLS + """, near as (select a.c, a.y, a.x, b.v w from cells a, range(-1, 2) p(dy), range(-1, 2) q(dx), cells b where b.c = a.c
  and b.y = case when a.y + dy < 0 then -(a.y + dy) - 1 when a.y + dy > 7 then 15 - (a.y + dy) else a.y + dy end and b.x = case when a.x + dx < 0 then -(a.x + dx) - 1 when a.x + dx > 7 then 15 - (a.x + dx) else a.x + dx end)"""


@query("g10_local_statistics", f"with {NEAR} select c as \"case\", y, x, round(avg(w), 6) mean, round(stddev_pop(w), 6) std, round(median(w), 6) median, round(max(w) - min(w), 6) \"range\" from near group by all")
def local_statistics(t: Tables) -> DataFrame:
    whole = t.embeddings.repartition("vec_id")
    return rounded(grids.local_statistics(grids.cells(whole, "vec_id", "embedding", 8), 1))


_MIRROR = "case when {0} < 0 then -({0}) - 1 when {0} > 7 then 15 - ({0}) else {0} end"


STACK = CELLS + ", stack as (select c // 4 k, (c % 4)::int z, y, x, v from cells), deep as (select k, max(z) + 1 n from stack group by 1)"
_FOLD_BACK = "case when (({0}) % (2 * n) + 2 * n) % (2 * n) >= n then 2 * n - 1 - (({0}) % (2 * n) + 2 * n) % (2 * n) else (({0}) % (2 * n) + 2 * n) % (2 * n) end"


def volumes(t: Tables, parts: int | None = None) -> DataFrame:
    """Up to four vectors as the layers of a 4 x 8 x 8 volume, in so many partitions, or as many as their size asks for.

    A case's vectors meet before they become cells, so what goes on by case moves no cell.
    """
    by = ("case",) if parts is None else (parts, "case")
    stack = F.col("vec_id")
    layers = t.embeddings.select(F.floor(stack / 4).cast("long").alias("case"), (stack % 4).cast("int").alias("z"), "embedding").repartition(*by)
    at = layers.select("case", "z", F.posexplode("embedding").alias("_i", "v"))
    return at.select("case", "z", F.floor(F.col("_i") / 8).cast("int").alias("y"), (F.col("_i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


@query("g09_laws", f"""with {STACK}, k(o, e, l, s) as (values (-2, 1, 1, -1), (-1, 2, 4, 0), (0, 0, 6, 2), (1, -2, 4, 0), (2, -1, 1, -1)),
  a as (select p.k, p.z, p.y, p.x, sum(k.s * q.v) v from stack p, k, stack q where q.k = p.k and q.z = p.z and q.y = p.y and q.x = {_MIRROR.format('p.x + o')} group by all),
  b as (select p.k, p.z, p.y, p.x, sum(k.l * q.v) v from a p, k, a q where q.k = p.k and q.z = p.z and q.x = p.x and q.y = {_MIRROR.format('p.y + o')} group by all)
  select p.k as "case", p.z, p.y, p.x, round(sum(k.e * q.v), 5) v from b p join deep using (k), k, b q where q.k = p.k and q.y = p.y and q.x = p.x
  and q.z = {_FOLD_BACK.format("p.z + o")} group by all""")
def laws(t: Tables) -> DataFrame:
    """An unsymmetrical code: edges along z, level along y, spots along x."""
    return rounded(grids.laws(volumes(t), "E5L5S5"), 5)


@query("g11_sobel", f"""with {CELLS}, d as (select * from (values (-1, -1, 1), (0, 0, 2), (1, 1, 1)) t(o, e, l)),
  h as (select a.c, a.y, a.x, sum(d.e * b.v) v from cells a, d, cells b where b.c = a.c and b.x = a.x and b.y = {_MIRROR.format('a.y + o')} group by all)
  select a.c as "case", a.y, a.x, round(sum(d.l * b.v), 5) v from h a, d, h b where b.c = a.c and b.y = a.y and b.x = {_MIRROR.format('a.x + o')} group by all""")
def sobel(t: Tables) -> DataFrame:
    return rounded(grids.sobel(images(t), "y"), 5)


@query("a24_heatmap_average", f"""with {CELLS}, p as (select * from cells where y % 3 = 1 and x % 3 = 1)
  select a.c as "case", a.y, a.x, round(coalesce(avg(p.v), 0), 6) heat from cells a left join p on p.c = a.c and abs(p.y - a.y) <= 1 and abs(p.x - a.x) <= 1 and p.v > 0 group by all""")
def heatmap_average(t: Tables) -> DataFrame:
    patches = images(t).filter("y % 3 = 1 and x % 3 = 1 and v > 0").withColumnRenamed("v", "score")
    return rounded(grids.average_heatmap(patches, images(t), 1))


REACH = HOT.replace("with ", "") + """, reach(c, y, x, root) as (select c, y, x, y * 8 + x from hot union select h.c, h.y, h.x, r.root from reach r join hot h on h.c = r.c and abs(h.y - r.y) <= 1 and abs(h.x - r.x) <= 1),
  lab as (select c, y, x, min(root) root from reach group by all)"""


@query("g19_components", f"with recursive {REACH} select c as \"case\", y, x, dense_rank() over (partition by c order by root)::int \"label\" from lab")
def components(t: Tables) -> DataFrame:
    return grids.components(hot(t)).select("case", "y", "x", "label")


@query("a25_component_table", f"""with recursive {REACH} select c as "case", dense_rank() over (partition by c order by root)::int "label", voxels, round(voxels * 0.75::double, 6) volume, layers, round(span * 3.0::double, 6) span, round(mean, 6) mean, round(mx, 6) max, round(p90, 6) p90 from
  (select c, root, count(*)::bigint voxels, count(distinct y)::bigint layers, max(y) - min(y) + 1 span, avg(v) mean, max(v) mx, quantile_cont(v, 0.9) p90 from lab join hot using (c, y, x) group by 1, 2)""")
def component_table(t: Tables) -> DataFrame:
    return rounded(grids.component_table(grids.components(hot(t)), 0.75, "y", 3.0))


@query("w11_layer_support", f"""with {HOT}, z as (select c // 4 k, (c % 4)::int z, y, x from hot) select distinct a.k as "case", a.z, a.y, a.x from z a join z b on b.k = a.k and abs(b.z - a.z) = 1 and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1""")
def layer_support(t: Tables) -> DataFrame:
    stack = hot(t).select(F.floor(F.col("case") / 4).cast("long").alias("case"), (F.col("case") % 4).cast("int").alias("z"), "y", "x")
    return grids.layer_supported(stack)


SHOWN = (
    "a_core_mean", "a_ring_mean", "b_core_p90", "b_ring_p90", "a_core_minus_ring_std", "a_core_ring_ratio_rms", "a_core_grad_mean", "a_ring_grad_mean", "a_core_minus_ring_grad_max", "a_core_glcm_contrast",
    "a_ring_glcm_contrast", "a_core_glcm_entropy", "a_ring_glcm_entropy", "a_ring_glcm_asm", "a_core_ring_ratio_glcm_homogeneity", "a_ring_glcm_correlation", "a_b_core_corr", "a_b_core_mean_diff", "a_b_core_std_ratio",
)


def contexts(t: Tables) -> DataFrame:
    """Two modalities on every second cell of each layer; the core is three by three, its context twice as far and a layer to either side."""
    cells = volumes(t, spread(t.spark)).select("case", "z", "y", "x", F.col("v").alias("a"), (F.col("v") * F.col("v") + F.col("y") / 8).alias("b"))
    centres = cells.filter("y % 2 = 1 and x % 2 = 1").select("case", F.col("z").alias("pz"), F.col("y").alias("py"), F.col("x").alias("px"))
    return context_features(cells, centres, (0, 1, 1), "a", "b")


_DIFF = "case when {0} is null and {1} is null then 0 when {0} is null then {1} - v when {1} is null then v - {0} else ({1} - {0}) / 2 end"


@query("g06_core_ring", f"""with {STACK}, two as (select k, z, y, x, v a, v * v + y / 8.0::double b from stack), c as (select k, z pz, y py, x px from two where y % 2 = 1 and x % 2 = 1),
  m as (select c.*, z, y, x, a, b, z = pz and abs(y - py) <= 1 and abs(x - px) <= 1 core from c join two on two.k = c.k and abs(z - pz) <= 1 and abs(y - py) <= 2 and abs(x - px) <= 2),
  p as (select k, pz, py, px, z, y, x, a v, 'core' part, true own from m where core union all select k, pz, py, px, z, y, x, a, 'ring', not core from m),
  g as (select *, lag(v) over wz zl, lead(v) over wz zn, lag(v) over wy yl, lead(v) over wy yn, lag(v) over wx xl, lead(v) over wx xn from p
    window wz as (partition by k, pz, py, px, part, y, x order by z), wy as (partition by k, pz, py, px, part, z, x order by y), wx as (partition by k, pz, py, px, part, z, y order by x)),
  r as (select *, sqrt(pow({_DIFF.format('zl', 'zn')}, 2) + pow({_DIFF.format('yl', 'yn')}, 2) + pow({_DIFF.format('xl', 'xn')}, 2)) grad from g),
  s as (select k, pz, py, px, part, avg(v) filter (own) mean, stddev_pop(v) filter (own) std, sqrt(avg(v * v) filter (own)) rms, avg(grad) filter (own) gmean, max(grad) filter (own) gmax from r group by all),
  l as (select *, min(z) over w + ((max(z) over w - min(z) over w + 1) // 2) at_ from p window w as (partition by k, pz, py, px, part)),
  f as (select *, median(v) filter (own) over w fill, min(y) filter (own) over w y0, max(y) filter (own) over w y1, min(x) filter (own) over w x0, max(x) filter (own) over w x1 from l where z = at_ window w as (partition by k, pz, py, px, part)),
  e as (select k, pz, py, px, part, y, x, case when own then v else fill end v from f where y between y0 and y1 and x between x0 and x1),
  h as (select *, min(v) over w lo, max(v) over w hi from e window w as (partition by k, pz, py, px, part)),
  q as (select k, pz, py, px, part, y, x, case when hi - lo < 1e-12 then 0 else greatest(0, least(15, floor((v - lo) / (hi - lo + 1e-12) * 16)))::int end q from h),
  o as (select u.k, u.pz, u.py, u.px, u.part, u.q i, w.q j from q u join q w on w.k = u.k and w.pz = u.pz and w.py = u.py and w.px = u.px and w.part = u.part
    and ((w.y = u.y and w.x = u.x + 1) or (w.y = u.y + 1 and w.x in (u.x - 1, u.x, u.x + 1)))),
  n as (select k, pz, py, px, part, i, j, count(*) n from (select * from o union all select k, pz, py, px, part, j, i from o) group by all),
  d as (select *, n / sum(n) over (partition by k, pz, py, px, part) p from n),
  x as (select k, pz, py, px, part, sum(p * (i - j) * (i - j)) contrast, -sum(p * ln(p)) entropy, sum(p * p) asm_, sum(p / (1 + abs(i - j))) homogeneity, sum(p * i) mu, sum(p * i * i) s2, sum(p * i * j) ij from d group by all),
  y as (select k, pz, py, px, quantile_cont(b, 0.9) filter (core) c90, quantile_cont(b, 0.9) filter (not core) r90, corr(a, b) filter (core) corr, avg(a) filter (core) - avg(b) filter (core) diff,
    stddev_pop(a) filter (core) / (stddev_pop(b) filter (core) + 1e-12) ratio from m group by all)
  select s.k as "case", s.pz, s.py, s.px, round(s.mean, 6) a_core_mean, round(t.mean, 6) a_ring_mean, round(c90, 6) b_core_p90, round(r90, 6) b_ring_p90, round(s.std - t.std, 6) a_core_minus_ring_std,
    round(s.rms / (t.rms + 1e-12), 6) a_core_ring_ratio_rms, round(s.gmean, 6) a_core_grad_mean, round(t.gmean, 6) a_ring_grad_mean, round(s.gmax - t.gmax, 6) a_core_minus_ring_grad_max,
    round(v.contrast, 6) a_core_glcm_contrast, round(w.contrast, 6) a_ring_glcm_contrast, round(v.entropy, 6) a_core_glcm_entropy, round(w.entropy, 6) a_ring_glcm_entropy, round(w.asm_, 6) a_ring_glcm_asm,
    round(v.homogeneity / (w.homogeneity + 1e-12), 6) a_core_ring_ratio_glcm_homogeneity, round((w.ij - w.mu * w.mu) / (w.s2 - w.mu * w.mu + 2e-12), 6) a_ring_glcm_correlation,
    round(corr, 6) a_b_core_corr, round(diff, 6) a_b_core_mean_diff, round(ratio, 6) a_b_core_std_ratio
  from s join s t using (k, pz, py, px) join x v using (k, pz, py, px) join x w using (k, pz, py, px) join y using (k, pz, py, px) where s.part = 'core' and t.part = 'ring' and v.part = 'core' and w.part = 'ring'""")  # fmt: skip
def core_ring(t: Tables) -> DataFrame:
    """Features of each kind, of those that ``g06_context_features`` has."""
    return rounded(contexts(t).select("case", "pz", "py", "px", *SHOWN))


@query("g06_context_features")
def context_row(t: Tables) -> DataFrame:
    """All 301 features of every centre."""
    return contexts(t)


@query("g15_topology", f"""with {HOT}, v as (select c, count(*) n from (select distinct c, (y + i)::int y, (x + j)::int x from hot, range(2) p(i), range(2) q(j)) group by 1),
  e as (select c, count(*) n from (select distinct c, 'x' d, (y + i)::int y, x from hot, range(2) p(i) union select distinct c, 'y', y, (x + i)::int from hot, range(2) p(i)) group by 1), f as (select c, count(*) n from hot group by 1)
  select c as "case", f.n::bigint volume, (v.n - e.n + f.n)::bigint euler from f join v using (c) join e using (c)""")
def topology(t: Tables) -> DataFrame:
    return grids.euler(hot(t))


@query("g16_region_features", f"""with {HOT} select c as "case", round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(min(v), 6) min, round(max(v), 6) max, round(median(v), 6) median, round(quantile_cont(v, 0.9), 6) p90, round(avg(v * v), 6) energy from hot group by 1""")
def region_features(t: Tables) -> DataFrame:
    made = hot(t).groupBy("case").agg(*stats.moments15(F.col("v")))
    return rounded(made.select("case", "mean", "std", "min", "max", "median", "p90", "energy"))


@query("a26_zone_majority", f"with {HOT} select c as \"case\", (count(*) filter (x >= 4) > count(*) filter (x < 4))::int zone from hot group by 1")
def zone_majority(t: Tables) -> DataFrame:
    tz = F.count_if(F.col("x") >= 4)
    return hot(t).groupBy("case").agg((tz > F.count_if(F.col("x") < 4)).cast("int").alias("zone"))


@query("a27_overlap_labels", f"""with {CELLS}, o as (select c, (y // 4)::int py, (x // 4)::int px, avg((v > 0)::int) lesion_overlap, avg((x < 5)::int) pz_overlap, avg((x >= 5)::int) tz_overlap from cells group by all),
  s as (select *, case when lesion_overlap >= 0.5 then 1 when lesion_overlap <= 0 then 0 end::int cs_label from o)
  select c as "case", py, px, lesion_overlap, pz_overlap, tz_overlap, cs_label, case when coalesce(cs_label, 0) = 1 then null when pz_overlap >= 0.8 and pz_overlap >= tz_overlap then 0 when tz_overlap >= 0.8 and tz_overlap > pz_overlap then 1 end::int zone_label from s""")
def overlap_labels(t: Tables) -> DataFrame:
    zone = F.when(F.col("x") < 5, "PZ").otherwise("TZ")
    placed = images(t).withColumn("py", F.floor(F.col("y") / 4).cast("int")).withColumn("px", F.floor(F.col("x") / 4).cast("int"))
    return grids.overlap_labels(placed, F.col("v") > 0, zone, ["case", "py", "px"])
