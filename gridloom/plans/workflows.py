"""Composed queries: patches and case summaries (G05, M05, G21, G23, G24, L16) and model runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cases, grids, workflows
from ..operators.learning import GRID
from ..operators.sampling import draw, folds, nested_folds
from .aggregates import rounded
from .grids import CELLS, HOT, hot, images
from .learning import table
from .registry import Tables, query

CENTRES = HOT + """, b as (select c, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from hot group by 1), l as (select c, r.y::int y, s.x::int x from b, lateral unnest(range(y0, y1 + 1, 2)) r(y), lateral unnest(range(x0, x1 + 1, 2)) s(x)),
  m as (select c, ((y0 + y1) // 2)::int y, ((x0 + x1) // 2)::int x from b), o as (select a.c, a.y, a.x, count(*) / 9.0::double overlap from (select * from l union select * from m) a join hot h on h.c = a.c and abs(h.y - a.y) <= 1 and abs(h.x - a.x) <= 1 group by all),
  g as (select o.* from o semi join l using (c, y, x) where overlap >= 0.4), p as (select * from g union all select o.* from o semi join m using (c, y, x) where c not in (select c from g))"""


@query("g05_patch_table", f"with {CENTRES} select c as \"case\", y, x, round(overlap, 6) overlap from p")
def patch_table(t: Tables) -> DataFrame:
    return rounded(cases.patch_centres(hot(t), 1, 2, 0.4))


def labelled_patches(t: Tables) -> DataFrame:
    """Every 3 x 3 patch inside each grid with its labels."""
    centres = images(t).filter("y between 1 and 6 and x between 1 and 6").select("case", F.col("y").alias("py"), F.col("x").alias("px"))
    span = lambda a: F.explode(F.sequence(F.col(f"p{a}") - 1, F.col(f"p{a}") + 1)).alias(a)
    cells = centres.select("case", "py", "px", span("y")).select("case", "py", "px", "y", span("x"))
    met = cells.join(images(t), ["case", "y", "x"])
    made = grids.overlap_labels(met, F.col("v") > 0.1, F.when(F.col("x") < 4, "PZ").otherwise("TZ"), ["case", "py", "px"])
    return made.withColumnsRenamed({"py": "y", "px": "x"})


PATCHES = CELLS + """, o as (select a.c, a.y, a.x, avg((b.v > 0.1)::int) l, avg((b.x < 4)::int) pz, avg((b.x >= 4)::int) tz from cells a join cells b on b.c = a.c and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1 where a.y between 1 and 6 and a.x between 1 and 6 group by all),
  q as (select *, case when l >= 0.5 then 1 when l <= 0 then 0 end cs, md5('7|' || c || '|' || y || '|' || x) k from o), z as (select *, case when coalesce(cs, 0) = 1 then null when pz >= 0.8 and pz >= tz then 0 when tz >= 0.8 and tz > pz then 1 end zl from q),
  pos as (select c, y, x from z where cs = 1 qualify row_number() over (partition by c order by l desc, k, y, x) <= 20), w as (select c, count(*) * 2 want from pos group by 1),
  neg as (select z.*, coalesce(want, 40) want, coalesce(zl, -1) zz, row_number() over (partition by c, coalesce(zl, -1) order by k, y, x) n from z left join w using (c) where cs = 0),
  neg2 as (select *, row_number() over (partition by c order by (zz < 0 or n > ceil(want / 2)), k, y, x) r from neg)"""


@query("m05_training_patches", f"with {PATCHES} select c as \"case\", y, x, 'positive' patch_source from pos union all select c, y, x, 'negative' from neg2 where r <= want")
def training_patches(t: Tables) -> DataFrame:
    return cases.training_choice(labelled_patches(t), 7).select("case", "y", "x", "patch_source")


@query("l12_candidate_status", """with s as (select distinct o_orderpriority candidate, o_custkey k from orders where o_totalprice > 100000), n as (select distinct candidate from s),
  a as (select c_custkey k, c_nationkey < 20 train from customer where c_nationkey < 20 or c_custkey in (select k from s where candidate = '1-URGENT')),
  m as (select n.candidate, a.k, train, s.k is null gone from a cross join n left join s on s.candidate = n.candidate and s.k = a.k),
  g as (select candidate, list(k order by k)[1:8] e from m where gone group by 1),
  c as (select candidate, count(*) filter (train) n, count(*) filter (train and gone) missing_train, count(*) filter (not train and gone) missing_held from m group by 1)
  select candidate, round(1 - missing_train / n, 6) coverage, missing_train::bigint missing_train, missing_held::bigint missing_held, array_to_string(coalesce(e, []), ',') examples,
  1 - missing_train / n >= 0.5 and missing_held = 0 kept from c left join g using (candidate)""")
def candidate_status(t: Tables) -> DataFrame:
    """Which priorities' large orders reach half of the customers of most nations, and all others that one of them reaches."""
    scores = t.orders.filter("o_totalprice > 100000").select(F.col("o_orderpriority").alias("candidate"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("score"))
    customers = t.customer.select(F.col("c_custkey").alias("k"), "c_nationkey")
    held = customers.filter("c_nationkey >= 20").join(scores.filter("candidate = '1-URGENT'"), "k", "left_semi")
    made = workflows.candidate_status(scores, customers.filter("c_nationkey < 20"), held, "k", 0.5)
    return made.select("candidate", F.round("coverage", 6).alias("coverage"), "missing_train", "missing_held", F.array_join("examples", ",").alias("examples"), "kept")


@query("l16_patch_likelihoods", f"""with {CELLS}, p as (select c, y, x, 1 / (1 + exp(-v)) a, x / 7.0::double b from cells)
  select c as "case", y, x, round(a, 6) cs, round(1 - a, 6) non_cs, round(1 - b, 6) pz, round(b, 6) tz, round(a * (1 - b), 6) cs_pz, round(a * b, 6) cs_tz from p""")
def patch_likelihoods(t: Tables) -> DataFrame:
    return rounded(images(t).select("case", "y", "x", *cases.likelihoods(1 / (1 + F.exp(-F.col("v"))), F.col("x") / F.lit(7.0))))


CANDIDATES = [{"c": 0.5, "k": 10, "pca": None, "model": ("lr", 1.0)}, {"c": 0.5, "k": 10, "pca": 0.95, "model": ("lda", None)}]


def own_folds(t: Tables, name: str = "fold") -> DataFrame:
    return folds(table(t).select("case_id", "y"), ["y"], 4, [draw(42, "case_id"), "case_id"], name, pieces=False).select("case_id", name)


@query("l11_out_of_fold")
def out_of_fold(t: Tables) -> DataFrame:
    return workflows.out_of_fold(table(t), own_folds(t), workflows.candidates_of(t.spark, CANDIDATES), "case_id", "x", "y")


@query("l04_best_bases")
def best_bases(t: Tables) -> DataFrame:
    return workflows.best_bases(out_of_fold(t), 4)


@query("l20_deployable_models")
def deployable_models(t: Tables) -> DataFrame:
    return workflows.fit_all(table(t), workflows.candidates_of(t.spark, CANDIDATES), "x", "y")


@query("l21_external_scores")
def external_scores(t: Tables) -> DataFrame:
    """Models and scale from one half of the features' columns, used on the other half as a new cohort."""
    own, candidates = table(t, 32), workflows.candidates_of(t.spark, CANDIDATES)
    other = t.embeddings.select(F.col("vec_id").alias("case_id"), F.slice(F.col("embedding").cast("array<double>"), 33, 32).alias("x"))
    return workflows.stacked_external(workflows.fit_all(own, candidates, "x", "y"), workflows.out_of_fold(own, own_folds(t), candidates, "case_id", "x", "y"), other, "case_id", "x")


@query("r09_nested_run")
def nested_run(t: Tables) -> DataFrame:
    nested = nested_folds(table(t), "case_id", ["y"], 4, 4, 42).select("case_id", "outer_fold", "inner_fold")
    return workflows.nested_run(table(t), nested, own_folds(t, "outer_fold"), "case_id", "x", "y", GRID, "vectors")["predictions"]
