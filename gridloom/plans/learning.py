"""Learning queries (L01 to L24) on vectors labelled by their digit's parity, and on documents."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..operators import estimators, fits, trees
from ..operators import learning as L
from ..operators import workflows
from ..operators.metrics import binary_metrics
from ..operators.sampling import capped, draw, folds, nested_folds
from ..session import shared_path
from .aggregates import rounded
from .registry import Tables, query


def table(t: Tables, width: int = 64) -> DataFrame:
    """Cases with ``width`` features and a two-class label."""
    return t.embeddings.select(F.col("vec_id").alias("case_id"), F.slice(F.col("embedding").cast("array<double>"), 1, width).alias("x"), (F.col("label") % 2).cast("int").alias("y"))


@query("l01_preprocess", """with m as (select median(c_acctbal) a, median(c_nationkey) b from customer), f as (select c_custkey, coalesce(case when c_custkey % 11 = 0 then null else c_acctbal end, (select median(c_acctbal) from customer where c_custkey % 11 <> 0)) bal,
  c_nationkey::double nat from customer), s as (select avg(bal) ma, stddev_pop(bal) sa, avg(nat) mn, stddev_pop(nat) sn from f)
  select c_custkey, round((bal - ma) / sa, 6) bal, round((nat - mn) / sn, 6) nat from f, s""")
def preprocess(t: Tables) -> DataFrame:
    """Of four columns the constant one and the double of another go."""
    bal = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal"))
    wide = t.customer.select("c_custkey", bal.alias("bal"), F.col("c_nationkey").cast("double").alias("nat"), F.lit(1.0).alias("one"), (F.col("c_nationkey") * 2.0 + 1).alias("twice"))
    made, kept = L.prepared(wide, ["bal", "nat", "one", "twice"])
    return rounded(made.select("c_custkey", *kept))


@query("l02_l1_selector")
def l1_selector(t: Tables) -> DataFrame:
    w = L.logistic(table(t), "x", "y", 0.5, True)[:-1]
    return t.spark.createDataFrame([(int(r) + 1, int(i), float(w[i])) for r, i in enumerate(models.top_features(w, 20))], "rank int, feature int, weight double")


@query("l03_pca_shares")
def pca_shares(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(L.variance_shares(table(t), "x"), "axis int, share double, cumulative double")


@query("l04_linear_models")
def linear_models(t: Tables) -> DataFrame:
    """Scores of a ridge logistic model fitted by MLlib, worked out inside the JVM."""
    return table(t).select("case_id", "y", L.linear_score(F.col("x"), L.logistic(table(t), "x", "y", 1.0, False)).alias("score"))


@query("l04_discriminant")
def discriminant(t: Tables) -> DataFrame:
    """Scores of a linear discriminant with optimal shrinkage, fitted from summed moments and worked out inside the JVM."""
    return table(t).select("case_id", "y", F.round(L.linear_score(F.col("x"), fits.whole_discriminant(table(t), "x", "y")), 6).alias("score"))


@query("l04_discriminant_two_features", """with d as (select vec_id case_id, embedding[1]::double a, embedding[2]::double b, label % 2 y from embeddings),
  m as (select avg(a) filter (y = 0) a0, avg(b) filter (y = 0) b0, avg(a) filter (y = 1) a1, avg(b) filter (y = 1) b1, count(*) filter (y = 1) n1, count(*) filter (y = 0) n0 from d),
  r as (select avg(pow(a - case when y = 1 then a1 else a0 end, 2)) saa, avg(pow(b - case when y = 1 then b1 else b0 end, 2)) sbb,
    avg((a - case when y = 1 then a1 else a0 end) * (b - case when y = 1 then b1 else b0 end)) * 0.8 sab from d, m),
  w as (select *, (sbb * (a1 - a0) - sab * (b1 - b0)) / (saa * sbb - sab * sab) wa, (saa * (b1 - b0) - sab * (a1 - a0)) / (saa * sbb - sab * sab) wb from m, r)
  select case_id, round(1 / (1 + exp(-(wa * a + wb * b + ln(n1::double / n0) - (wa * (a0 + a1) + wb * (b0 + b1)) / 2))), 6) score from d, w""")
def two_features(t: Tables) -> DataFrame:
    """With two features and a shrinkage of a fifth, which SQL can express: correlations weigh four fifths."""
    two = table(t, 2)
    return two.select("case_id", F.round(L.linear_score(F.col("x"), fits.whole_discriminant(two, "x", "y", 0.2)), 6).alias("score"))


@query("l01_pipeline")
def pipeline_scores(t: Tables) -> DataFrame:
    """Preparation and discriminant as stages of a pipeline, saved and loaded before they score."""
    path = shared_path(t.spark, "pipeline")
    stages = [estimators.Preparer(inputCol="x"), estimators.Discriminant(labelCol="y")]
    Pipeline(stages=stages).fit(table(t)).write().overwrite().save(path)
    return PipelineModel.load(path).transform(table(t)).select("case_id", "y", F.round("score", 6).alias("score"))


@query("l07_inner_search")
def inner_search(t: Tables) -> DataFrame:
    splits = nested_folds(table(t), "case_id", ["y"], 4, 4, 42).select("case_id", "outer_fold", "inner_fold")
    return L.inner_search(table(t), splits, "case_id", "x", "y")


@query("l08_best_parameters")
def best_parameters(t: Tables) -> DataFrame:
    return L.best_parameters(inner_search(t))


@query("l09_outer_evaluation")
def outer_evaluation(t: Tables) -> DataFrame:
    own = folds(table(t).select("case_id", "y"), ["y"], 4, [draw(42, "case_id"), "case_id"], "outer_fold").select("case_id", "outer_fold")
    made = L.outer_scores(table(t), own, best_parameters(t), "case_id", "x", "y").filter("not inner").withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return binary_metrics(made, ["outer_fold"], "y", "score", "pred")


@query("l12_stacked_scores")
def stacked_scores(t: Tables) -> DataFrame:
    own = folds(table(t).select("case_id", "y"), ["y"], 4, [draw(42, "case_id"), "case_id"], "outer_fold").select("case_id", "outer_fold")
    candidates = workflows.candidates_of(t.spark, [{"c": 0.5, "k": 10, "pca": None, "model": model} for model in (("lr", 1.0), ("lda", None))])
    made = L.base_scores(table(t), workflows.inner_folds(table(t), own, "case_id", "y", 4, 42), own, candidates, "case_id", "x", "y")
    return L.meta_scores(made, "case_id")


@query("l15_calibrated_forest")
def calibrated_forest(t: Tables) -> DataFrame:
    """Three forests of 600 extremely randomised trees, each calibrated on the fold that it hasn't seen."""
    return trees.calibrated_scores(table(t), "case_id", "x", "y")


def bags(t: Tables, number: Column | None = None) -> DataFrame:
    """Vectors in 25 bags, or in those that ``number`` gives; a bag is positive if it holds two vectors of digit 9."""
    number = F.col("vec_id") % F.lit(25) if number is None else number
    b = t.embeddings.select(number.cast("long").alias("bag"), F.col("embedding").cast("array<double>").alias("x"), F.col("label"))
    positive = b.groupBy("bag").agg((F.count_if(F.col("label") == 9) >= 2).cast("int").alias("y"))
    return b.join(positive, "bag").select("bag", "x", "y", (F.col("bag") % 4).cast("int").alias("fold"))


@query("l17_bag_scores")
def bag_scores(t: Tables) -> DataFrame:
    return L.bag_scores(bags(t), "bag", "x", models.MaxPool(64, 8, 7))


@query("l17_bag_maxima", "select vec_id % 25 bag, i - 1 unit, round(max(greatest(embedding[i]::double, 0)), 6) h from embeddings, range(1, 65) r(i) group by 1, 2")
def bag_maxima(t: Tables) -> DataFrame:
    """The largest of each of 64 rectified components over a bag."""
    long = bags(t).select("bag", F.posexplode("x").alias("unit", "v"))
    return long.groupBy("bag", F.col("unit").cast("long").alias("unit")).agg(F.round(F.max(F.greatest("v", F.lit(0.0))), 6).alias("h"))


@query("l18_bag_standardiser", """with r as (select vec_id, row_number() over (partition by vec_id % 25 order by md5('42|' || vec_id), vec_id) n from embeddings),
  e as (select e.vec_id, i - 1 unit, embedding[i]::double v, n from embeddings e join r using (vec_id), range(1, 65) k(i)),
  s as (select unit, avg(v) m, stddev_pop(v) s from e where n <= 3000 group by 1)
  select vec_id, unit, round((v - m) / case when s < 1e-8 then 1 else s end, 6) z from e join s using (unit)""")
def bag_standardiser(t: Tables) -> DataFrame:
    """All 64 components, scaled by at most 3,000 rows a bag."""
    e = t.embeddings.select("vec_id", (F.col("vec_id") % 25).alias("bag"), F.posexplode(F.col("embedding").cast("array<double>")).alias("unit", "v"))
    fitted = capped(t.embeddings.select("vec_id", (F.col("vec_id") % 25).alias("bag")), ["bag"], 3000, [draw(42, "vec_id"), "vec_id"]).select("vec_id")
    s = e.join(fitted, "vec_id").groupBy("unit").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = (F.col("v") - F.col("m")) / F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s"))
    return e.join(F.broadcast(s), "unit").select("vec_id", F.col("unit").cast("long").alias("unit"), F.round(z, 6).alias("z"))


@query("l19_bag_evaluation")
def bag_evaluation(t: Tables) -> DataFrame:
    """Twenty vectors a bag: every 500 ids make 25 bags, so that more vectors make more bags and not ones that are all positive."""
    v = F.col("vec_id")
    return L.train_bags(bags(t, F.floor(v / 500) * 25 + v % 25), "bag", "x", "y", "fold")
