"""Stores, reports and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grids, metrics, workflows
from ..operators import relational as rel
from ..session import shared_path
from ..sources import models, tables
from ..streaming import resume
from .aggregates import icc_table, rounded
from .grids import HOT, hot
from .joins import raters
from .learning import table
from .registry import Tables, query
from .windows import FUSED, METRICS, POINTS, RANK, SCORED, fused
from .workflows import CANDIDATES, own_folds


@query("s06_tolerant_sheet", "select n_nationkey, n_name, n_regionkey from nation")
def tolerant_sheet(t: Tables) -> DataFrame:
    """A sheet that is there, and one that isn't and has no rows."""
    path = shared_path(t.spark, "book")
    tables.write_sheets(path, {"nation": t.nation})
    there, gone = (tables.read_sheet(t.spark, path, name, t.nation.schema) for name in ("nation", "gone"))
    return there.unionByName(gone)


@query("s13_model_store", "select * from (values (1, 'fitted', 2::bigint), (2, 'stored', 2), (3, 'fitted', 2)) v(attempt, how, models)")
def model_store(t: Tables) -> DataFrame:
    """Models made, found again under the same settings, and made anew under others."""
    path, told = shared_path(t.spark, "models"), []
    for k, seed in enumerate((42, 42, 7)):
        found, there = models.stored_or_fitted(t.spark, path, {"seed": seed, "cap": 20000}, lambda: workflows.fit_all(table(t), workflows.candidates_of(t.spark, CANDIDATES), "x", "y"))
        told.append((k + 1, "stored" if there else "fitted", found.count()))
    return t.spark.createDataFrame(told, "attempt int, how string, models long")


@query("s18_published_sheets")
def published_sheets(t: Tables) -> DataFrame:
    """The sheets of a stacking run, published as one unit with four decimal places; the folds' sheet, read again."""
    path = shared_path(t.spark, "stacking")
    sheets = stacking_sheets(t)
    tables.write_sheets(path, sheets, places=4)
    return tables.read_sheet(t.spark, path, "folds", sheets["folds"].schema)


@query("g04_patch_geometry", """with m as (select c_custkey, (c_custkey % 60)::double mm, 0.5 + (c_nationkey % 5) * 0.5::double sp from customer), n as (select *, greatest(1, round_even(mm / sp, 0)::int) n from m)
  select c_custkey, case when n % 2 = 1 then n else n + 1 end::int cells from n""")
def patch_geometry(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", grids.odd_cells_of((F.col("c_custkey") % 60).cast("double"), F.lit(0.5) + (F.col("c_nationkey") % 5) * 0.5).alias("cells"))


@query("g25_hotspots", f"with {HOT}, r as (select c, count(*)::bigint cells, count(distinct y)::bigint layers, max(y) - min(y) + 1 span, max(v) top from hot group by 1) select c as \"case\", cells, layers, span::int span, round(top, 6) top from r where layers >= 2")
def hotspots(t: Tables) -> DataFrame:
    """Hot cells of cases in which at least two layers are hot."""
    made = hot(t).groupBy("case").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("y").alias("layers"), (F.max("y") - F.min("y") + 1).alias("span"), F.round(F.max("v"), 6).alias("top"))
    return made.filter("layers >= 2")


@query("l05_score_extraction", SCORED + "z as (select doc_id, (a_score - 70) / 10 m from c) select doc_id, round(1 / (1 + exp(-m)), 6) score, (1 / (1 + exp(-m)) >= 0.5)::int pred from z")
def score_extraction(t: Tables) -> DataFrame:
    margin = (F.col("a_score") - 70) / 10
    score = 1 / (1 + F.exp(-margin))
    return fused(t).select("doc_id", F.round(score, 6).alias("score"), (score >= 0.5).cast("int").alias("pred"))


@query("l10_fixed_candidate")
def fixed_candidate(t: Tables) -> DataFrame:
    halves = table(t).join(own_folds(t), "case_id")
    return workflows.fixed_candidate(halves.filter("fold < 2"), halves.filter("fold >= 2"), CANDIDATES[0], "case_id", "x", "y")


def stacking_sheets(t: Tables) -> dict[str, DataFrame]:
    return workflows.stacking(table(t), own_folds(t, "outer_fold"), CANDIDATES, "case_id", "x", "y")


@query("l25_stacking_run")
def stacking_run(t: Tables) -> DataFrame:
    return stacking_sheets(t)["summary"]


@query("l26_mean_of_candidates", SCORED + f"r as (select doc_id, y, {RANK.format('a_score')} an, {RANK.format('b_score')} bn from c) select doc_id, y, round((an + bn) / 2, 8) score from r")
def mean_of_candidates(t: Tables) -> DataFrame:
    f = fused(t)
    long = reduce(DataFrame.unionByName, (f.select("doc_id", "y", F.col(c).alias("s")) for c in ("a_norm", "b_norm")))
    return long.groupBy("doc_id", "y").agg(F.round(F.avg("s"), 8).alias("score"))


@query("r01_stage_run", "select * from (values (1, 'features', 'run'), (1, 'scores', 'run'), (2, 'features', 'skipped'), (2, 'scores', 'skipped'), (3, 'features', 'run'), (3, 'scores', 'run')) v(attempt, stage, outcome)")
def stage_run(t: Tables) -> DataFrame:
    """Two stages run, skipped, and run again after the first one's result has become invalid."""
    paths = {n: shared_path(t.spark, n) for n in ("features", "scores")}
    wanted = t.customer.select("c_custkey")
    valid = lambda n: lambda: resume.complete(tables.scan_or_empty(t.spark, paths[n], wanted.schema), wanted, ["c_custkey"])
    build = {"features": lambda: tables.publish(wanted, paths["features"]), "scores": lambda: tables.publish(t.spark.read.parquet(paths["features"]), paths["scores"])}
    stages = [resume.Stage("features", build["features"], valid("features")), resume.Stage("scores", build["scores"], valid("scores"), ["features"])]
    told = []
    for attempt in (1, 2, 3):
        if attempt == 3:
            tables.publish(wanted.filter("c_custkey > 3"), paths["features"])
        told += [(attempt, *line) for line in resume.Run(stages)(["scores"])]
    return t.spark.createDataFrame(told, "attempt int, stage string, outcome string")


@query("r03_missing_results", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def missing_results(t: Tables) -> DataFrame:
    return rel.missing_keys(t.customer, t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("r04_built_upstream", "select n_name, count(*)::bigint customers from customer join nation on c_nationkey = n_nationkey group by 1")
def built_upstream(t: Tables) -> DataFrame:
    """A table that is made where it is missing, then used."""
    path = shared_path(t.spark, "upstream")
    schema = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name").schema
    if tables.scan_or_empty(t.spark, path, schema).isEmpty():
        tables.publish(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), path)
    return t.customer.join(t.spark.read.parquet(path), "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("r05_run_log", """with s as (select c_mktsegment name, count(*)::bigint n from customer group by 1)
  select name, case when n > (select avg(n) from s) then 2 else 1 end::bigint times, n as "rows" from s""")
def run_log(t: Tables) -> DataFrame:
    """Completion marks of segments, appended by two runs, of which the second only does the larger ones; counted."""
    path = shared_path(t.spark, "log")
    done = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    mean = done.agg(F.avg("rows").alias("mean"))
    for run in (done, done.crossJoin(F.broadcast(mean)).filter("rows > mean").drop("mean")):
        run.coalesce(1).write.mode("append").parquet(path)
    return t.spark.read.schema(done.schema).parquet(path).groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.max("rows").alias("rows"))


@query("r07_parallel_extraction", "select vec_id case_id, round(list_sum(list_transform(embedding, lambda v: v::double * v::double)), 5) energy from embeddings")
def parallel_extraction(t: Tables) -> DataFrame:
    """A feature of each case by itself, in the tasks that read the cases."""
    energy = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda total, v: total + v * v)
    return t.embeddings.select(F.col("vec_id").alias("case_id"), F.round(energy, 5).alias("energy"))


@query("r08_stable_book", """select o_orderkey case_id, o_orderstatus label, round(median(l_quantity), 6) quantity, round(median(l_extendedprice), 6) price, round(median(l_discount), 6) discount, round(median(l_tax), 6) tax
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
def stable_book(t: Tables) -> DataFrame:
    a, b = raters(t)
    labels = t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("label"))
    return rounded(workflows.stable_book(a, b, ["case_id"], ["quantity", "price", "discount", "tax", "constant"], labels, icc_table))


@query("r10_early_fusion", """select c_custkey case_id, c_acctbal, n, round(total, 4) total from customer left join (select o_custkey, count(*)::bigint n, sum(o_totalprice) total from orders group by 1) on o_custkey = c_custkey""")
def early_fusion(t: Tables) -> DataFrame:
    main = t.customer.select(F.col("c_custkey").alias("case_id"), "c_acctbal")
    helper = t.orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"), F.lit(0.0).alias("c_acctbal"))
    return rel.left_wins(main, helper, ["case_id"])


@query("r12_curve_report", FUSED + POINTS + """select 'pooled ' || fold variant, case when max(pos) > 0 and max(neg) > 0 then round(sum(py * (neg - fp) + py * ny / 2) / max(pos * neg), 8) end auc, case when max(pos) > 0 and max(neg) > 0 then round(sum(py / pos * tp / (tp + fp)), 8) end ap, round(max(pos) / (max(pos) + max(neg)), 8) prevalence from k group by fold""")
def curve_report(t: Tables) -> DataFrame:
    f = fused(t)
    share = f.groupBy("fold").agg(F.avg("y").alias("prevalence"))
    made = metrics.auc_ap(f, ["fold"], "y", "score").join(share, "fold")
    return made.select(F.concat(F.lit("pooled "), F.col("fold").cast("string")).alias("variant"), *(F.round(c, 8).alias(c) for c in ("auc", "ap", "prevalence")))


@query("r13_combined_report", FUSED + """s as (select 'first' experiment, fold, y, an score from r union all select 'second', fold, y, bn from r union all select 'late', fold, y, score from f),
  p as (select experiment, fold, score, sum(y)::double py, sum(1 - y)::double ny from s group by 1, 2, 3),
  k as (select *, sum(ny) over (partition by experiment, fold order by score desc) fp, sum(py) over (partition by experiment, fold) pos, sum(ny) over (partition by experiment, fold) neg from p),
  a as (select experiment, fold, sum(py * (neg - fp) + py * ny / 2) / max(pos * neg) auc from k where pos > 0 and neg > 0 group by 1, 2),
  n as (select experiment, fold, count(*) n, avg((y = (score >= 0.5)::int)::int) acc from s group by 1, 2)
  select experiment, sum(n)::bigint n, count(auc)::bigint folds, round(avg(auc), 6) auc_mean, round(stddev_pop(auc), 6) auc_std, round(avg(acc), 6) acc_mean from n left join a using (experiment, fold) group by 1""")
def combined_report(t: Tables) -> DataFrame:
    """Both sources and their late fusion side by side: cases, folds with both classes, and the spread of their metrics."""
    f = fused(t)
    parts = [f.select("doc_id", "fold", "y", F.col(c).alias("score"), F.lit(name).alias("experiment")) for name, c in (("first", "a_norm"), ("second", "b_norm"), ("late", "score"))]
    long = reduce(DataFrame.unionByName, parts).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    m = metrics.binary_metrics(long, ["experiment", "fold"], "y", "score", "pred")
    return rounded(m.groupBy("experiment").agg(
        F.sum("n").alias("n"), F.count("auc").alias("folds"), F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.avg("acc").alias("acc_mean"),
    ))
