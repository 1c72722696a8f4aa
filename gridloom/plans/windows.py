"""Windows (W01 to W12), sampling (M01 to M04), score fusion and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import metrics, ordered, ranking, sampling
from ..operators.relational import first_rows, grid
from .registry import Tables, query


def scored(t: Tables) -> DataFrame:
    """Cases with a fold, a label and two scores with ties."""
    d = t.documents.select("doc_id", (F.log1p(F.col("n_chars")) * 10).cast("int").cast("double").alias("a_score"), (F.col("doc_id") % 13).cast("double").alias("b_score"))
    return t.labels.select("doc_id", F.col("quality").alias("y")).join(d, "doc_id").withColumn("fold", (F.col("doc_id") % 4).cast("int"))


SCORED = """with c as (select l.doc_id, quality y, floor(ln(1 + n_chars) * 10)::double a_score, (l.doc_id % 13)::double b_score, (l.doc_id % 4)::int fold from labels l join documents d using (doc_id)), """
RANK = "case when count({0}) over (partition by fold) <= 1 then 0.5 else (rank() over (partition by fold order by {0}) + (count(*) over (partition by fold, {0}) - 1) / 2.0::double - 1) / (count({0}) over (partition by fold) - 1) end"
FUSED = SCORED + f"r as (select *, {RANK.format('a_score')} an, {RANK.format('b_score')} bn from c), f as (select *, 0.5::double * an + 0.5::double * bn score from r), "


@query("w01_rank01", SCORED + f"z as (select doc_id, {RANK.format('a_score')} r from c) select doc_id, round(r, 8) r from z")
def rank01(t: Tables) -> DataFrame:
    return ordered.rank01(scored(t).select("doc_id", "fold", "a_score"), "a_score", ["fold"], "r").select("doc_id", F.round("r", 8).alias("r"))


@query("w02_cap_per_group", "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by coalesce(value, -1) desc, event_id) r from events) where r <= 3")
def cap_per_group(t: Tables) -> DataFrame:
    return sampling.capped(t.events, ["user_id", "event_type"], 3, [F.coalesce("value", F.lit(-1.0)).desc(), "event_id"]).select("event_id", "user_id", "event_type")


@query("w03_best_fold", """select p, f, round(v, 4) v from (select *, row_number() over (partition by p order by v desc, f) r from (select o_orderpriority p, (o_custkey % 4)::int f, avg(o_totalprice) v from orders group by all)) where r = 1""")
def best_fold(t: Tables) -> DataFrame:
    v = t.orders.groupBy(F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 4).cast("int").alias("f")).agg(F.avg("o_totalprice").alias("v"))
    return ranking.best_per_group(v, ["p"], [F.desc("v"), F.col("f")]).select("p", "f", F.round("v", 4).alias("v"))


@query("w04_keep_first_last", """select a.user_id, a.event_id first_id, b.event_id last_id from (select * from (select *, row_number() over (partition by user_id order by ts, event_id) r from events) where r = 1) a
  join (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1) b using (user_id)""")
def keep_first_last(t: Tables) -> DataFrame:
    first = first_rows(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", F.col("event_id").alias("first_id"))
    last = first_rows(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_id").alias("last_id"))
    return first.join(last, "user_id")


@query("w05_ecdf_reference", """with ref as (select event_type g, value v from events where event_id % 3 = 0), n as (select g, count(*)::double n from ref group by 1),
  q as (select event_id, event_type g, value v from events where event_id % 3 <> 0)
  select event_id, round(least(greatest((select count(*) from ref where ref.g = q.g and ref.v <= q.v) / n, 0.5 / n), 1 - 0.5 / n), 8) u from q join n using (g)""")
def ecdf_reference(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.col("event_type").alias("g"), F.col("value").alias("v"))
    made = ordered.ecdf(e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0"), ["g"], "v", "u")
    return made.select("event_id", F.round("u", 8).alias("u"))


DAYS = "(select user_id u, date_diff('day', timestamp '2024-01-01', ts)::int d, count(*)::bigint n from events group by 1, 2)"


@query("w06_sliding_sum_argmax", f"""with x as (select *, sum(n) over w s, count(*) over w k, count(*) over (partition by u) m from {DAYS} window w as (partition by u order by d rows between current row and 2 following))
  select u, d start, s::bigint total from (select *, row_number() over (partition by u order by s desc, abs(d + 1.0::double - 15), d) r from x where k = 3 or (m < 3 and k = m)) where r = 1""")
def sliding_sum_argmax(t: Tables) -> DataFrame:
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("int")
    n = t.events.groupBy(F.col("user_id").alias("u"), day.alias("d")).agg(F.count(F.lit(1)).alias("n")).withColumn("near", F.lit(15))
    return ranking.best_window(n, "u", "d", "n", 3, "near")


@query("w07_finite_differences", """with x as (select event_id, user_id, value v, lag(value) over w p, lead(value) over w n from events window w as (partition by user_id order by ts, event_id))
  select event_id, round(case when p is null and n is null then 0 when p is null then n - v when n is null then v - p else (n - p) / 2 end, 6) g from x""")
def finite_differences(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p, n, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    g = F.when(p.isNull() & n.isNull(), 0.0).when(p.isNull(), n - v).when(n.isNull(), v - p).otherwise((n - p) / 2)
    return t.events.select("event_id", F.round(g, 6).alias("g"))


POINTS = "p as (select fold, score, sum(y)::double py, sum(1 - y)::double ny from f group by 1, 2), k as (select *, sum(py) over w tp, sum(ny) over w fp, sum(py) over (partition by fold) pos, sum(ny) over (partition by fold) neg from p window w as (partition by fold order by score desc)) "


def fused(t: Tables) -> DataFrame:
    c = scored(t)
    return metrics.late_fusion(c.select("doc_id", "fold", "y", "a_score"), c.select("doc_id", "b_score"), ["doc_id"], ["fold"])


@query("w08_roc_points", FUSED + POINTS + "select fold, round(score, 8) score, round(fp / nullif(neg, 0), 8) fpr, round(tp / nullif(pos, 0), 8) tpr, round(tp / (tp + fp), 8) prec from k")
def roc_points(t: Tables) -> DataFrame:
    p = metrics.curve_points(fused(t), ["fold"], "y", "score")
    return p.select("fold", F.round("score", 8).alias("score"), F.round(F.try_divide("fp", "neg"), 8).alias("fpr"), F.round(F.try_divide("tp", "pos"), 8).alias("tpr"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 8).alias("prec"))


@query("w09_candidate_ranking", """select g, o_orderkey, candidate_rank from (select o_orderstatus g, o_orderkey, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey)::int candidate_rank from orders) where candidate_rank <= 4""")
def candidate_ranking(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("g"), "o_orderkey", "o_totalprice", "o_orderpriority")
    return ranking.diverse_top(rows, ["g"], ["o_totalprice", "o_orderkey"], [False, True], 4, {"o_orderpriority": 0}).select("g", "o_orderkey", "candidate_rank")


@query("w09_candidate_caps", """with r as (select o_orderstatus g, o_orderkey, o_totalprice v, row_number() over (partition by o_orderstatus, o_orderpriority order by o_totalprice desc, o_orderkey) > 1 c from orders)
  select g, o_orderkey, row_number() over (partition by g order by c, v desc, o_orderkey)::int candidate_rank from r qualify row_number() over (partition by g order by c, v desc, o_orderkey) <= 7""")
def candidate_caps(t: Tables) -> DataFrame:
    """At most one order a priority, of which there are five, and the next best after them."""
    rows = t.orders.select(F.col("o_orderstatus").alias("g"), "o_orderkey", "o_totalprice", "o_orderpriority")
    return ranking.diverse_top(rows, ["g"], ["o_totalprice", "o_orderkey"], [False, True], 7, {"o_orderpriority": 1}).select("g", "o_orderkey", "candidate_rank")


@query("w09_penalised_ranking", """with c as (select o_orderstatus g, o_orderpriority p, o_custkey % 4 m, avg(o_totalprice / 1e5) mean, case when o_custkey % 4 > 0 then stddev_pop(o_totalprice / 1e5) end spread from orders group by 1, 2, 3),
  s as (select *, mean - 0.5 * coalesce(spread, max(spread) over (partition by g), 0) score from c)
  select g, p, m, round(score, 6) score, row_number() over (partition by g order by score desc, mean desc, spread nulls last, p, m)::int place from s qualify place <= 4""")
def penalised_ranking(t: Tables) -> DataFrame:
    """The best four candidates of each group by their mean less half their spread, which isn't known for some."""
    price, m = F.col("o_totalprice") / 1e5, F.col("o_custkey") % 4
    c = t.orders.groupBy(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("p"), m.alias("m")).agg(F.avg(price).alias("mean"), F.stddev_pop(price).alias("spread"))
    s = ranking.penalised(c.withColumn("spread", F.when(F.col("m") > 0, F.col("spread"))), ["g"], "mean", "spread", 0.5, "score")
    made = ranking.diverse_top(s, ["g"], ["score", "mean", "spread", "p", "m"], [False, False, True, True, True], 4, {})
    return made.select("g", "p", "m", F.round("score", 6).alias("score"), F.col("candidate_rank").alias("place"))


@query("w10_group_leaders", """with r as (select user_id, event_type, sum(value) s, row_number() over (partition by user_id order by sum(value) desc, event_type) r from events group by 1, 2)
  select user_id, round(max(s) filter (r = 1), 4) best, round(coalesce(max(s) filter (r = 2), 0), 4) runner_up, round(max(s) filter (r = 1) - coalesce(max(s) filter (r = 2), 0), 4) gap,
  round(avg(s) filter (r <= 2), 4) top2, round(sum(s) filter (r <= 3), 4) top3_total, round(max(s) filter (r = 1) / greatest(sum(s) filter (r <= 3), 1e-12), 6) concentration from r group by 1""")
def group_leaders(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("s"))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"), "event_type")))
    at = lambda n: F.coalesce(F.max(F.when(F.col("r") == n, F.col("s"))), F.lit(0.0))
    of = lambda f, n: f(F.when(F.col("r") <= n, F.col("s")))
    return r.groupBy("user_id").agg(
        F.round(at(1), 4).alias("best"), F.round(at(2), 4).alias("runner_up"), F.round(at(1) - at(2), 4).alias("gap"), F.round(of(F.avg, 2), 4).alias("top2"),
        F.round(of(F.sum, 3), 4).alias("top3_total"), F.round(at(1) / F.greatest(of(F.sum, 3), F.lit(1e-12)), 6).alias("concentration"),
    )


@query("w12_strided_sample", "select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) r from events) where (r - 1) % 7 = 0")
def strided_sample(t: Tables) -> DataFrame:
    return ranking.every_nth(t.events, "user_id", ["ts", "event_id"], 7).select("event_id", "user_id")


@query("s20_first_cases", "select event_id, user_id from events where user_id in (select user_id from events group by 1 order by min(event_id), user_id limit 5)")
def first_cases(t: Tables) -> DataFrame:
    return ranking.first_cases(t.events, "user_id", "event_id", 5).select("event_id", "user_id")


@query("m01_balanced_sample", """with s as (select toxic, count(*) n from labels group by 1), c as (select toxic, least(n, 20000, floor((select min(n) from s) * 2)) cap from s)
  select doc_id, l.toxic from (select *, row_number() over (partition by toxic order by md5('42|' || doc_id), doc_id) r from labels) l join c on c.toxic = l.toxic where r <= cap""")
def balanced_sample(t: Tables) -> DataFrame:
    return sampling.balanced(t.labels, "toxic", 20000, 2.0, [sampling.draw(42, "doc_id"), "doc_id"]).select("doc_id", "toxic")


@query("m02_stable_seed", "select c_custkey, ('0x' || substr(sha1('42|' || c_custkey || '|fine'), 1, 8))::bigint seed from customer")
def stable_seed(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", sampling.stable_seed(F.lit("42"), F.col("c_custkey").cast("string"), F.lit("fine")).alias("seed"))


@query("m03_sample_items", "select l_suppkey, l_partkey from (select *, row_number() over (partition by l_suppkey order by md5('7|' || l_partkey), l_partkey) r from (select distinct l_suppkey, l_partkey from lineitem)) where r <= 5")
def sample_items(t: Tables) -> DataFrame:
    return sampling.capped(t.lineitem.select("l_suppkey", "l_partkey").distinct(), ["l_suppkey"], 5, [sampling.draw(7, "l_partkey"), "l_partkey"])


_FOLD = "(row_number() over (partition by quality order by md5('{0}|' || doc_id), doc_id) - 1) % 4"


@query("m04_nested_folds", f"with o as (select doc_id, quality, {_FOLD.format(42)} own from labels) " + " union all ".join(
    f"select doc_id, quality, {k} outer_fold, ({_FOLD.format(42 + k)})::int inner_fold from o where own <> {k}" for k in range(4)))
def nested_folds(t: Tables) -> DataFrame:
    return sampling.nested_folds(t.labels, "doc_id", ["quality"], 4, 4, 42).select("doc_id", "quality", "outer_fold", "inner_fold")


METRICS = FUSED + POINTS + """, a as (select fold, sum(py * (neg - fp) + py * ny / 2) / max(pos * neg) auc, sum(py / pos * tp / (tp + fp)) ap from k where pos > 0 and neg > 0 group by 1),
  q as (select fold, count(*)::bigint n, count(*) filter (y = 1 and score >= 0.5)::double tp, count(*) filter (y = 0 and score < 0.5)::double tn, count(*) filter (y = 0 and score >= 0.5)::double fp,
  count(*) filter (y = 1 and score < 0.5)::double fn from f group by 1)
  select fold, n, round(coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)), 8) balanced_acc, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) f1, round((tp + tn) / n, 8) acc, round(tp / nullif(tp + fn, 0), 8) sensitivity,
  round(tn / nullif(tn + fp, 0), 8) specificity, round(auc, 8) auc, round(ap, 8) ap from q left join a using (fold)"""


@query("l14_late_fusion_metrics", METRICS)
def late_fusion_metrics(t: Tables) -> DataFrame:
    """Rank-normalised scores of two sources, blended and thresholded, with seven metrics a fold."""
    f = fused(t).withColumn("pred", clean.predicted(F.col("score"), F.lit("cs")))
    m = metrics.binary_metrics(f, ["fold"], "y", "score", "pred")
    return m.select("fold", "n", *(F.round(c, 8).alias(c) for c in m.columns if c not in ("fold", "n")))


@query("l14_late_fusion_scores", FUSED + "z as (select 1) select doc_id, fold, round(an, 8) a_norm, round(bn, 8) b_norm, round(score, 8) score from f")
def late_fusion_scores(t: Tables) -> DataFrame:
    return fused(t).select("doc_id", "fold", *(F.round(c, 8).alias(c) for c in ("a_norm", "b_norm", "score")))


@query("l06_binary_metrics", METRICS.replace("f as (select *, 0.5::double * an + 0.5::double * bn score from r)", "f as (select *, bn score from r)"))
def binary_metrics(t: Tables) -> DataFrame:
    f = fused(t).drop("score").withColumnRenamed("b_norm", "score").withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    m = metrics.binary_metrics(f, ["fold"], "y", "score", "pred")
    return m.select("fold", "n", *(F.round(c, 8).alias(c) for c in m.columns if c not in ("fold", "n")))


@query("l13_weighted_average", FUSED + """s as (select doc_id, y, an score, 'a' m from r union all select doc_id, y, bn, 'b' from r), p as (select m, score, sum(y)::double py, sum(1 - y)::double ny from s group by 1, 2),
  k as (select *, sum(ny) over (partition by m order by score desc) fp, sum(py) over (partition by m) pos, sum(ny) over (partition by m) neg from p),
  w as (select m, greatest(sum(py * (neg - fp) + py * ny / 2) / max(pos * neg) - 0.5, 0.001) w from k group by 1)
  select doc_id, round(sum(score * w) / sum(w), 8) score from s join w using (m) group by 1""")
def weighted_average(t: Tables) -> DataFrame:
    f = fused(t)
    long = f.select("doc_id", "y", F.col("a_norm").alias("score"), F.lit("a").alias("m")).unionByName(f.select("doc_id", "y", F.col("b_norm").alias("score"), F.lit("b").alias("m")))
    w = metrics.auc_ap(long, ["m"], "y", "score").select("m", F.greatest(F.col("auc") - 0.5, F.lit(0.001)).alias("w"))
    return long.join(w, "m").groupBy("doc_id").agg(F.round(F.sum(F.col("score") * F.col("w")) / F.sum("w"), 8).alias("score"))


@query("l22_confusion_full_grid", """with c as (select o_orderstatus g, (o_totalprice > 250000)::int y, (o_custkey % 3 = 0)::int p from orders), n as (select g, y, p, count(*) n from c group by all),
  x as (select g, y.y, p.p, coalesce(n, 0)::bigint n from (select distinct g from c) join (values (0), (1), (2)) y(y) on true join (values (0), (1), (2)) p(p) on true left join n using (g, y, p))
  select g, y, p, n, round(case when sum(n) over (partition by g, y) > 0 then n / sum(n) over (partition by g, y) else 0 end, 8) share from x""")
def confusion_full_grid(t: Tables) -> DataFrame:
    c = t.orders.select(F.col("o_orderstatus").alias("g"), (F.col("o_totalprice") > 250000).cast("int").alias("y"), (F.col("o_custkey") % 3 == 0).cast("int").alias("p"))
    return metrics.confusion(c, ["g"], "y", "p", [0, 1, 2]).select("g", "y", "p", "n", F.round("share", 8).alias("share"))


@query("l23_score_distribution", "select o_orderstatus g, count(*)::bigint n, round(min(o_totalprice), 4) q0, round(quantile_cont(o_totalprice, 0.25), 4) q1, round(median(o_totalprice), 4) q2, round(quantile_cont(o_totalprice, 0.75), 4) q3, round(max(o_totalprice), 4) q4 from orders group by 1")
def score_distribution(t: Tables) -> DataFrame:
    q = [F.percentile("o_totalprice", F.lit(p)) for p in (0.25, 0.5, 0.75)]
    return t.orders.groupBy(F.col("o_orderstatus").alias("g")).agg(F.count(F.lit(1)).alias("n"), *(F.round(c, 4).alias(f"q{k}") for k, c in enumerate([F.min("o_totalprice"), *q, F.max("o_totalprice")])))


@query("l24_base_model_use", """with u as (select o_orderstatus task, case when o_custkey % 2 = 0 then 'A' else 'B' end s, o_totalprice / 100000 w from orders)
  select task, s, count(*)::bigint used, round(sum(w), 4) weight from u group by all""")
def base_model_use(t: Tables) -> DataFrame:
    name = F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B")
    text = t.orders.select(F.col("o_orderstatus").alias("task"), F.to_json(F.create_map(name, F.col("o_totalprice") / 100000)).alias("weights"))
    used = text.select("task", F.explode(F.from_json("weights", "map<string,double>")).alias("s", "w"))
    return used.groupBy("task", "s").agg(F.count(F.lit(1)).alias("used"), F.round(F.sum("w"), 4).alias("weight"))


@query("u05_expected_grid", "select s task, m model, k::int fold, (select count(*) from orders where o_orderstatus = s and o_orderpriority = m and o_custkey % 4 = k) > 0 done from (select distinct o_orderstatus s from orders), (select distinct o_orderpriority m from orders), range(4) r(k)")
def expected_grid(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 4).cast("int").alias("fold"))
    full = grid(o.select("task").distinct(), o.select("model").distinct(), t.spark.range(4).select(F.col("id").cast("int").alias("fold")))
    return full.join(o.distinct().withColumn("_d", F.lit(True)), ["task", "model", "fold"], "left").select("task", "model", "fold", F.coalesce("_d", F.lit(False)).alias("done"))
