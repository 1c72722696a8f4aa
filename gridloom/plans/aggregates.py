"""Aggregations (A01 to A23; the grid aggregates A24 to A27 are with the grids)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import relational as rel
from ..operators.ordered import medians
from ..operators.sampling import capped
from ..operators.summaries import score_summary
from ..session import kept
from .joins import raters
from .registry import Tables, query


def rounded(df: DataFrame, places: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """df with its doubles rounded."""
    return df.select(*(F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" and f.name not in keep else F.col(f.name) for f in df.schema))


MOMENTS15 = """select event_type, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(var_pop(v), 6) var, min(v) min, max(v) max, round(median(v), 6) median,
  round(quantile_cont(v, 0.1), 6) p10, round(quantile_cont(v, 0.25), 6) p25, round(quantile_cont(v, 0.75), 6) p75, round(quantile_cont(v, 0.9), 6) p90,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) iqr, round(avg(pow((v - m) / s, 3)), 5) skew, round(avg(pow((v - m) / s, 4)), 4) kurt, round(sqrt(avg(v * v)), 6) rms, round(avg(v * v), 5) energy
  from (select event_type, value v, avg(value) over (partition by event_type) m, stddev_pop(value) over (partition by event_type) s from events) group by 1"""


@query("a01_moments15", MOMENTS15)
def moments15(t: Tables) -> DataFrame:
    made = t.events.groupBy("event_type").agg(*stats.moments15(F.col("value")))
    places = {"skew": 5, "kurt": 4, "energy": 5}
    return made.select("event_type", *(F.col(c) if c in ("min", "max") else F.round(c, places.get(c, 6)).alias(c) for c in made.columns[1:]))


@query("a02_moments4", """select l_returnflag, round(avg(pow((v - m) / s, 4)), 5) kurt, round(median(v), 6) median, round(avg(pow((v - m) / s, 3)), 5) skew, round(var_pop(v), 4) var
  from (select l_returnflag, l_quantity v, avg(l_quantity) over (partition by l_returnflag) m, stddev_pop(l_quantity) over (partition by l_returnflag) s from lineitem) group by 1""")
def moments4(t: Tables) -> DataFrame:
    made = t.lineitem.groupBy("l_returnflag").agg(*stats.moments4(F.col("l_quantity")))
    return made.select("l_returnflag", F.round("kurt", 5).alias("kurt"), "median", F.round("skew", 5).alias("skew"), F.round("var", 4).alias("var"))


_GE = {"0_50": 0.5, "0_60": 0.6, "0_70": 0.7, "0_80": 0.8, "threshold": 0.45}


@query("a03_score_summary23", """with x as (select event_type, case when isfinite(value) then least(value / 100, 1) end x from events), r as (select *, row_number() over (partition by event_type order by x desc nulls last) r, count(x) over (partition by event_type) n from x)
  select event_type, nullif(count(x), 0)::bigint count, round(avg(x), 6) mean, round(stddev_pop(x), 6) std, round(max(x), 6) max, round(median(x), 6) median, round(quantile_cont(x, 0.9), 6) p90, round(quantile_cont(x, 0.95), 6) p95,
  round(quantile_cont(x, 0.99), 6) p99, round(avg(x) filter (r <= 5), 6) top5_mean, round(avg(x) filter (r <= 10), 6) top10_mean, round(avg(x) filter (r <= 20), 6) top20_mean,
  round(avg(x) filter (r <= ceil(n * 0.01::double)), 6) top1pct_mean, round(avg(x) filter (r <= ceil(n * 0.05::double)), 6) top5pct_mean, """
  + ", ".join(f"case when count(x) > 0 then count(*) filter (x >= {v}) end::bigint count_ge_{k}, round(avg((x >= {v})::int), 6) frac_ge_{k}" for k, v in _GE.items()) + " from r group by 1")
def score_summary23(t: Tables) -> DataFrame:
    scored = t.events.select("event_type", F.least(F.col("value") / 100, F.lit(1.0)).alias("s"))
    return rounded(score_summary(scored, "event_type", "s", 0.45))


@query("a04_top_fraction_mean", """select user_id, round(avg(value) filter (r <= least(3, n)), 6) top3, round(avg(value) filter (r <= greatest(1, ceil(n * 0.1::double))), 6) top10pct from
  (select *, row_number() over (partition by user_id order by value desc, event_id) r, count(*) over (partition by user_id) n from events) group by 1""")
def top_fraction_mean(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    r = t.events.withColumn("_r", F.row_number().over(w.orderBy(F.desc("value"), "event_id"))).withColumn("_n", F.count(F.lit(1)).over(w))
    best = lambda n: F.round(F.avg(F.when(F.col("_r") <= n, F.col("value"))), 6)
    return r.groupBy("user_id").agg(best(F.lit(3)).alias("top3"), best(F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.1))).alias("top10pct"))


@query("a05_feature_frequency", "select l_partkey feature, count(*)::bigint freq, round(avg(l_discount), 6) mean_score, round(avg(l_linenumber), 6) mean_rank from lineitem group by 1")
def feature_frequency(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(F.col("l_partkey").alias("feature"))
    return g.agg(F.count(F.lit(1)).alias("freq"), F.round(F.avg("l_discount"), 6).alias("mean_score"), F.round(F.avg("l_linenumber"), 6).alias("mean_rank"))


@query("a06_fold_stability", """select p, round(avg(v), 4) mean, round(stddev_pop(v), 4) std, round(avg(v) - stddev_pop(v), 4) stability, count(*)::bigint folds from
  (select o_orderpriority p, o_custkey % 4 f, avg(o_totalprice) v from orders group by all) group by 1""")
def fold_stability(t: Tables) -> DataFrame:
    folds = t.orders.groupBy(F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 4).alias("f")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(folds.groupBy("p").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.avg("v") - F.stddev_pop("v")).alias("stability"), F.count(F.lit(1)).alias("folds")), 4)


@query("a07_mode_first_seen", """select o_custkey, o_orderpriority mode from (select *, row_number() over (partition by o_custkey order by n desc, f) r from
  (select o_custkey, o_orderpriority, count(*) n, min(o_orderkey) f from orders group by all)) where r = 1""")
def mode_first_seen(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("f"))
    return n.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", -F.col("f"))).alias("mode"))


@query("a08_class_distribution", """select o_orderpriority p, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' order by o_orderstatus) || '}' dist from
  (select o_orderpriority, o_orderstatus, count(*) n from orders group by all) group by 1""")
def class_distribution(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_orderpriority").alias("p"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("p").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))))).alias("dist"))


@query("a09_ensemble_average", """select l_orderkey case_id, l_returnflag task, round(avg(l_discount * 10), 6) score, (round(avg(l_discount * 10), 6) >= case when l_returnflag = 'R' then 0.45 else 0.5 end)::int pred from lineitem group by 1, 2""")
def ensemble_average(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("task")).agg(F.round(F.avg(F.col("l_discount") * 10), 6).alias("score"))
    return m.withColumn("pred", (F.col("score") >= F.when(F.col("task") == "R", F.lit(0.45)).otherwise(F.lit(0.5))).cast("int"))


@query("a10_pivot_sum", """select o_orderpriority p, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) f, round(sum(case when o_orderstatus = 'O' then o_totalprice else 0 end), 2) o,
  round(sum(case when o_orderstatus = 'P' then o_totalprice else 0 end), 2) p_ from orders group by 1""")
def pivot_sum(t: Tables) -> DataFrame:
    made = t.orders.groupBy(F.col("o_orderpriority").alias("p")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice")).na.fill(0.0).toDF("p", "F", "O", "p2")
    return made.select("p", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"), F.round("p2", 2).alias("p_"))


@query("a11_median_stages", "select l_returnflag task, median(l_quantity) quantity, round(median(l_extendedprice), 4) price, median(l_discount) discount, median(l_tax) tax, median(l_linenumber)::double line from lineitem group by 1")
def median_stages(t: Tables) -> DataFrame:
    stages = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber"}
    return t.lineitem.groupBy(F.col("l_returnflag").alias("task")).agg(*(F.round(F.median(c), 4).alias(k) if k == "price" else F.median(c).cast("double").alias(k) for k, c in stages.items()))


@query("a12_pooled_and_average", """with a as (select o_orderstatus task, count(*)::double n, avg(o_totalprice) v from orders where o_orderstatus in ('F', 'O') group by 1)
  select task, n, round(v, 4) v from a union all select 'average', avg(n), round(avg(round(v, 4)), 5) from a having count(*) = 2""")
def pooled_and_average(t: Tables) -> DataFrame:
    a = t.orders.filter(F.col("o_orderstatus").isin("F", "O")).groupBy(F.col("o_orderstatus").alias("task")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("v"))
    average = a.agg(F.count(F.lit(1)).alias("_k"), F.avg("n").alias("n"), F.round(F.avg("v"), 5).alias("v")).filter("_k = 2").select(F.lit("average").alias("task"), "n", "v")
    return a.unionByName(average)


def scale_agreement(df: DataFrame, case: str, scale: str, score: str) -> DataFrame:
    """How the scales of a case agree: figures a scale, then their spread over scales.

    Thresholds and the best scale hang on the last bit of a 95th percentile, so it is worked out from the two values beside it.
    """
    w = Window.partitionBy(case, scale)
    r = df.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(score))), "_p": (F.count(score).over(w) - 1) * F.lit(0.95), "_n": F.count(score).over(w)})
    at = lambda place: F.max(F.when(F.col("_r") == F.col("_n") - place(F.col("_p")), F.col(score)))
    figures = {"max": F.max(score), "top10_mean": F.avg(F.when(F.col("_r") <= 10, F.col(score))), "_low": at(F.floor), "_high": at(F.ceil), "_part": F.max(F.col("_p") - F.floor("_p"))}
    per = r.groupBy(case, scale).agg(*(f.alias(n) for n, f in figures.items())).withColumn("p95", stats.between(F.col("_low"), F.col("_high"), F.col("_part")))
    spread = [f(m).alias(f"{m}_{n}") for m in ("max", "p95", "top10_mean") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))]
    counts = [F.count_if(F.col(m) >= v).alias(f"n_{m}_ge_{k}") for m in ("max", "p95") for k, v in (("0_60", 0.6), ("0_70", 0.7), ("0_80", 0.8))]
    every = [F.bool_and(F.col("max") >= v).cast("int").alias(f"all_max_ge_{k}") for k, v in (("0_60", 0.6), ("0_80", 0.8))]
    return per.groupBy(case).agg(F.count(F.lit(1)).alias("n_scales"), *spread, *counts, *every, F.max("p95").alias("best_p95"), F.max_by("max", F.struct("p95", F.col(scale))).alias("best_max"))


@query("a13_scale_agreement", """with x as (select user_id c, event_type s, least(value / 100, 1) x, event_id from events), r as (select *, row_number() over (partition by c, s order by x desc) r from x),
  p as (select c, s, max(x) mx, quantile_cont(x, 0.95) p95, avg(x) filter (r <= 10) t from r group by 1, 2) select c user_id, count(*)::bigint n_scales, """
  + ", ".join(f"round({f}({m}), 8) {a}_{n}" for a, m in (("max", "mx"), ("p95", "p95"), ("top10_mean", "t")) for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_pop"))) + ", "
  + ", ".join(f"count(*) filter ({m} >= {v})::bigint n_{a}_ge_{k}" for a, m in (("max", "mx"), ("p95", "p95")) for k, v in (("0_60", 0.6), ("0_70", 0.7), ("0_80", 0.8)))
  + ", bool_and(mx >= 0.6)::int all_max_ge_0_60, bool_and(mx >= 0.8)::int all_max_ge_0_80, round(max(p95), 8) best_p95, round(arg_max(mx, row(p95, s)), 8) best_max from p group by 1")
def scale_agreement_query(t: Tables) -> DataFrame:
    return rounded(scale_agreement(t.events.select("user_id", "event_type", F.least(F.col("value") / 100, F.lit(1.0)).alias("x")), "user_id", "event_type", "x"), 8)


def icc_table(a: DataFrame, b: DataFrame, keys: list[str], features: list[str], constant: float = 0.9, least: float = 0.75) -> DataFrame:
    """A row a feature: agreement of two raters, the larger constant share, and whether it is stable.

    Features that are constant in either rater get no agreement. The raters meet as wide rows,
    which are kept; their long form is read from there and isn't shuffled, and no task holds
    a feature's values.
    """
    side = lambda df, s: df.select(*keys, *(F.col(f).cast("double").alias(f"_{s}{k}") for k, f in enumerate(features)))
    wide = kept(side(a, "a").join(side(b, "b"), keys).drop(*keys), "raters")
    long = wide.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_a{k}").alias("a"), F.col(f"_b{k}").alias("b")) for k, f in enumerate(features)))))
    sides = long.select("feature", F.inline(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("a", "b")))))
    found = medians(sides, ["feature", "side"], "v", "m").groupBy("feature").agg(*(F.max(F.when(F.col("side") == c, F.col("m"))).alias(f"m{c}") for c in ("a", "b")))
    told = long.groupBy("feature").agg(F.max(F.abs("a")).alias("xa"), F.max(F.abs("b")).alias("xb"), stats.icc2_1(F.col("a"), F.col("b")).alias("icc"))
    middle = kept(told.join(found, "feature", "left"), "icc")
    near = lambda v, m, x: F.avg((F.abs(F.col(v) - F.col(m)) <= 1e-8 + 1e-5 * F.greatest(F.lit(1.0), F.abs(F.col(m)), F.col(x))).cast("double"))
    share = long.join(F.broadcast(middle.select("feature", "ma", "mb", "xa", "xb")), "feature").groupBy("feature").agg(F.greatest(near("a", "ma", "xa"), near("b", "mb", "xb")).alias("constant_share"))
    both = middle.join(share, "feature").withColumn("icc", F.when(F.col("constant_share") < constant, F.col("icc")))
    return both.select("feature", "icc", "constant_share", (F.coalesce(F.col("icc"), F.lit(-1.0)) >= least).alias("stable"))


_RATED = "(select l_orderkey k, avg(l_quantity) quantity, avg(l_extendedprice) price, avg(l_discount) discount, avg(l_tax) tax, 1.0 constant from lineitem group by 1)"
_RATED2 = "(select l_orderkey k, median(l_quantity) quantity, median(l_extendedprice) price, median(l_discount) discount, median(l_tax) tax, 1.0 constant from lineitem group by 1)"
_LONG = "(unpivot {0} on quantity, price, discount, tax, constant into name feature value v)"
ICC = f"""with l as (select a.feature, a.v::double a, b.v::double b from {_LONG.format(_RATED)} a join {_LONG.format(_RATED2)} b using (k, feature)),
  m as (select feature, count(*)::double n, var_pop((a + b) / 2) vm, var_pop(a - b) vd, avg(a) ma, avg(b) mb, median(a) da, median(b) db, max(abs(a)) xa, max(abs(b)) xb from l group by 1),
  q as (select *, 2 * vm * n / (n - 1) r, n * (ma - mb) * (ma - mb) / 2 c, vd * n / 2 / (n - 1) e from m),
  s as (select feature, greatest(avg((abs(a - da) <= 1e-8 + 1e-5 * greatest(1, abs(da), xa))::int), avg((abs(b - db) <= 1e-8 + 1e-5 * greatest(1, abs(db), xb))::int)) f from l join m using (feature) group by 1),
  i as (select feature, f, case when f < 0.9 and abs(r + e + 2 * (c - e) / n) >= 1e-12 then (r - e) / (r + e + 2 * (c - e) / n) end icc from q join s using (feature))"""


@query("a14_icc_two_raters", ICC + " select feature, round(icc, 6) icc, round(f, 6) constant_share, coalesce(icc, -1) >= 0.75 stable from i")
def icc_two_raters(t: Tables) -> DataFrame:
    return rounded(icc_table(*raters(t), ["case_id"], ["quantity", "price", "discount", "tax", "constant"]))


@query("a15_constant_fraction", """with m as (select l_returnflag g, median(l_tax) d, max(abs(l_tax)) x from lineitem group by 1)
  select g, round(avg((abs(l_tax - d) <= 1e-8 + 1e-5 * greatest(1, abs(d), x))::int), 6) share from lineitem join m on g = l_returnflag group by 1""")
def constant_fraction(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("g")).agg(F.median("l_tax").alias("d"), F.max(F.abs("l_tax")).alias("x"))
    near = F.abs(F.col("l_tax") - F.col("d")) <= 1e-8 + 1e-5 * F.greatest(F.lit(1.0), F.abs("d"), F.col("x"))
    return t.lineitem.select(F.col("l_returnflag").alias("g"), "l_tax").join(m, "g").groupBy("g").agg(F.round(F.avg(near.cast("double")), 6).alias("share"))


@query("a16_icc_stable_features", ICC + " select feature, rank() over (order by icc desc)::int rank from i where icc >= 0.75")
def icc_stable_features(t: Tables) -> DataFrame:
    table = icc_table(*raters(t), ["case_id"], ["quantity", "price", "discount", "tax", "constant"])
    return table.filter("stable").select("feature", F.rank().over(Window.orderBy(F.desc("icc"))).alias("rank"))


@query("a17_icc_bins", """select event_type, count(*) filter (x >= 0 and x < 0.5)::bigint b0, count(*) filter (x >= 0.5 and x < 0.75)::bigint b1, count(*) filter (x >= 0.75 and x < 0.9)::bigint b2,
  count(*) filter (x >= 0.9 and x <= 1)::bigint b3 from (select event_type, value / 100 - 0.1 x from events) group by 1""")
def icc_bins(t: Tables) -> DataFrame:
    x = F.col("value") / 100 - 0.1
    edges = ((0.0, 0.5), (0.5, 0.75), (0.75, 0.9), (0.9, 1.0))
    return t.events.groupBy("event_type").agg(*(stats.bin_count(x, a, b, k == 3).alias(f"b{k}") for k, (a, b) in enumerate(edges)))


@query("a18_total_rows", "select coalesce(l_returnflag, 'SUM') kind, count(*)::bigint n, round(sum(l_quantity), 2) total from lineitem group by rollup (l_returnflag) union all select 'AVERAGE', null, round(avg(total), 2) from (select sum(l_quantity) total from lineitem group by l_returnflag)")
def total_rows(t: Tables) -> DataFrame:
    rolled = t.lineitem.rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")).select(F.coalesce("l_returnflag", F.lit("SUM")).alias("kind"), "n", F.round("total", 2).alias("total"))
    average = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total")).agg(F.round(F.avg("total"), 2).alias("total")).select(F.lit("AVERAGE").alias("kind"), F.lit(None).cast("long").alias("n"), "total")
    return rolled.unionByName(average)


@query("a19_dedup_then_sum", """select o_orderpriority p, round(sum(o_totalprice), 2) total from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) r from orders) where r = 1 group by 1""")
def dedup_then_sum(t: Tables) -> DataFrame:
    first = rel.first_rows(t.orders, ["o_custkey", "o_orderpriority"], [F.col("o_orderkey")])
    return first.groupBy(F.col("o_orderpriority").alias("p")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a20_standardised_difference", """with f as (select e.feature, e.v, l.quality y from (unpivot (select doc_id, n_chars::double n_chars, (doc_id % 97)::double res, length(source)::double src from documents) on n_chars, res, src into name feature value v) e
  join labels l using (doc_id)) select feature, round((avg(v) filter (y = 1) - avg(v) filter (y = 0)) / sqrt((var_samp(v) filter (y = 1) + var_samp(v) filter (y = 0)) / 2), 6) smd from f group by 1
  having count(v) filter (y = 1) >= 3 and count(v) filter (y = 0) >= 3 and coalesce(var_samp(v) filter (y = 1) + var_samp(v) filter (y = 0), 0) > 0""")
def standardised_difference(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), (F.col("doc_id") % 97).cast("double").alias("res"), F.length("source").cast("double").alias("src"))
    long = rel.long_form(d, ["doc_id"], ["n_chars", "res", "src"]).join(t.labels.select("doc_id", "quality"), "doc_id")
    return long.groupBy("feature").agg(F.round(stats.smd(F.col("value"), F.col("quality")), 6).alias("smd")).filter("smd is not null")


@query("a21_group_top_mean", "select n_name g, round(avg(c_acctbal), 6) best from (select *, row_number() over (partition by c_nationkey order by abs(c_acctbal) desc, c_custkey) r from customer) join nation on c_nationkey = n_nationkey where r <= 10 group by 1")
def group_top_mean(t: Tables) -> DataFrame:
    kept = capped(t.customer, ["c_nationkey"], 10, [F.abs("c_acctbal").desc(), "c_custkey"])
    return kept.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("g")).agg(F.round(F.avg("c_acctbal"), 6).alias("best"))


@query("a22_multi_seed_mean", """select s task, p model, round(avg(v), 3) v from (select o_custkey % 5 seed, o_orderstatus s, o_orderpriority p, avg(o_totalprice) v from orders group by all) group by 1, 2""")
def multi_seed_mean(t: Tables) -> DataFrame:
    seeds = [t.orders.filter(F.col("o_custkey") % 5 == k).groupBy(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("v")) for k in range(5)]
    return reduce(DataFrame.unionByName, seeds).groupBy("task", "model").agg(F.round(F.avg("v"), 3).alias("v"))


@query("a23_model_table", """select task, model, v from (select distinct o_orderstatus task from orders), (values ('1-URGENT'), ('2-HIGH'), ('9-NONE')) m(model) left join
  (select o_orderstatus s, o_orderpriority p, round(avg(o_totalprice), 3) v from orders group by all) on s = task and p = model""")
def model_table(t: Tables) -> DataFrame:
    models = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "model string")
    v = t.orders.groupBy(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice"), 3).alias("v"))
    return rel.grid(t.orders.select(F.col("o_orderstatus").alias("task")).distinct(), models).join(v, ["task", "model"], "left")
