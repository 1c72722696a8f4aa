"""Joins, set operations and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean, stats
from ..operators import relational as rel
from ..operators.ordered import numbered
from ..operators.ranges import containing
from ..operators.sampling import capped
from .registry import Tables, query


@query("j01_left_wins", "select o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_name, c.c_acctbal from orders o left join customer c on o.o_custkey = c.c_custkey and c.c_acctbal > 0")
def left_wins(t: Tables) -> DataFrame:
    right = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal", F.lit(-1.0).alias("o_totalprice"))
    return rel.left_wins(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), right, ["o_custkey"])


@query("j02_multiway_inner", """select o_orderkey, l_linenumber, l_partkey, l_suppkey, c_mktsegment, n_name, r_name from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def multiway_inner(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    customers = t.customer.withColumnRenamed("c_custkey", "o_custkey").withColumnRenamed("c_nationkey", "n_nationkey")
    nations = t.nation.withColumnRenamed("n_regionkey", "r_regionkey")
    whole = rel.inner_all([lines, t.orders.select("o_orderkey", "o_custkey")], ["o_orderkey"])
    whole = rel.inner_all([whole, customers], ["o_custkey"])
    whole = rel.inner_all([rel.inner_all([whole, nations], ["n_nationkey"]), t.region], ["r_regionkey"])
    return whole.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_mktsegment", "n_name", "r_name")


@query("j03_one_to_one", "select doc_id, quality, toxic from labels")
def one_to_one(t: Tables) -> DataFrame:
    return rel.one_to_one(t.labels.select("doc_id", "quality"), t.labels.select("doc_id", "toxic"), ["doc_id"])


@query("j04_full_outer", """select coalesce(c_custkey, s_suppkey * 20) k, c_acctbal, s_acctbal from customer full outer join supplier on c_custkey = s_suppkey * 20""")
def full_outer(t: Tables) -> DataFrame:
    """All customers and suppliers on keys that overlap in part, so that both sides keep unmatched rows."""
    c = t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal")
    return c.join(t.supplier.select((F.col("s_suppkey") * 20).alias("k"), "s_acctbal"), "k", "full_outer")


def raters(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two raters' features of the same orders, as wide tables; both read one shuffle of the rows by order, so they meet without another."""
    measures = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    by = t.lineitem.select(F.col("l_orderkey").alias("case_id"), *measures.values()).repartition("case_id").groupBy("case_id")
    first = by.agg(*(F.avg(c).alias(n) for n, c in measures.items()))
    held = by.agg(F.collect_list(F.struct(*measures.values())).alias("_held"))
    second = held.select("case_id", *(stats.middle(F.col("_held")[c]).alias(n) for n, c in measures.items()))
    return first.withColumn("constant", F.lit(1.0)), second.withColumn("constant", F.lit(1.0))


@query("j05_rater_alignment", """select l_orderkey case_id, 'quantity' feature, round(avg(l_quantity), 6) v1, round(median(l_quantity), 6) v2 from lineitem group by 1 union all
  select l_orderkey, 'tax', round(avg(l_tax), 6), round(median(l_tax), 6) from lineitem group by 1""")
def rater_alignment(t: Tables) -> DataFrame:
    a, b = (rel.long_form(x, ["case_id"], ["quantity", "tax"]) for x in raters(t))
    both = a.withColumnRenamed("value", "v1").join(b.withColumnRenamed("value", "v2"), ["case_id", "feature"])
    return both.select("case_id", "feature", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2"))


@query("j06_semi_join", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def semi_join(t: Tables) -> DataFrame:
    chosen = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("j07_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def anti_join(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return rel.missing_keys(t.customer, done, ["c_custkey"])


@query("j08_lookup", "select event_id, user_id, c_mktsegment seg from events left join customer on user_id = c_custkey")
def lookup(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id").join(t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("seg")), "user_id", "left")


@query("j09_ordered_reindex", """select id, pos, v from (select c_custkey id, row_number() over (order by c_acctbal, c_custkey)::int pos from customer) left join
  (select user_id, min_by(value, ts) v from events group by 1) on id = user_id""")
def ordered_reindex(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal")
    wanted = numbered(customers, ["c_acctbal", "id"], "pos").select("id", F.col("pos").cast("int").alias("pos"))
    first = t.events.groupBy(F.col("user_id").alias("id")).agg(F.min_by("value", "ts").alias("v"))
    return wanted.join(first, "id", "left").select("id", "pos", "v")


@query("j10_reference_order", """with r as (select o_orderpriority p, min(o_orderkey) f from orders group by 1) select p, n, row_number() over (order by f nulls last, p)::int place
  from (select o_orderpriority p, count(*)::bigint n from orders group by 1) join r using (p)""")
def reference_order(t: Tables) -> DataFrame:
    counted = t.orders.groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    ordered = rel.in_order_of(counted, t.orders.select(F.col("o_orderpriority").alias("p"), "o_orderkey"), "o_orderkey", ["p"])
    first = t.orders.groupBy(F.col("o_orderpriority").alias("p")).agg(F.min("o_orderkey").alias("f"))
    return ordered.join(first, "p").select("p", "n", F.row_number().over(Window.orderBy(F.col("f").asc_nulls_last(), "p")).alias("place"))


@query("j11_task_average", """with a as (select o_orderpriority p, o_orderstatus s, avg(o_totalprice) v from orders where o_custkey % 2 = 0 group by all), b as
  (select o_orderpriority p, o_orderstatus s, avg(o_totalprice) v from orders where o_custkey % 2 = 1 group by all) select p, s, round((a.v + b.v) / 2, 3) both_mean from a join b using (p, s)""")
def task_average(t: Tables) -> DataFrame:
    part = lambda r, n: t.orders.filter(F.col("o_custkey") % 2 == r).groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.avg("o_totalprice").alias(n))
    return part(0, "a").join(part(1, "b"), ["p", "s"]).select("p", "s", F.round((F.col("a") + F.col("b")) / 2, 3).alias("both_mean"))


@query("j12_feature_minimum", """with a as (select l_suppkey k, avg(l_tax) v from lineitem where l_returnflag = 'A' group by 1), b as (select l_suppkey k, avg(l_tax) v from lineitem
  where l_returnflag = 'R' group by 1) select k, round(least(a.v, b.v), 6) low from a join b using (k)""")
def feature_minimum(t: Tables) -> DataFrame:
    part = lambda flag, n: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_tax").alias(n))
    return part("A", "a").join(part("R", "b"), "k").select("k", F.round(F.least("a", "b"), 6).alias("low"))


@query("j13_range_containment", """select a.event_id center, b.event_id covered from events a join events b on a.user_id = b.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000
  where a.event_type = 'purchase'""")
def range_containment(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    centers = t.events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("center"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mid"))
    found = containing(centers, e.withColumnRenamed("event_id", "covered"), ["user_id"], "mid", "at", 3600 * 1_000_000)
    return found.select("center", "covered")


@query("j14_leakage_keys", """select distinct regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') k from customer join orders on c_custkey = o_custkey where o_orderstatus = 'F'""")
def leakage_keys(t: Tables) -> DataFrame:
    left = t.customer.select("c_custkey", clean.loose_key(F.col("c_name")).alias("k"))
    raw = t.orders.filter("o_orderstatus = 'F'").select(F.format_string(" customer-%09d ", "o_custkey").alias("name"))
    return left.join(raw.select(clean.loose_key(F.col("name")).alias("k")).distinct(), "k").select("k").distinct()


@query("j15_parameter_grid", """select s, c, k::int k from (select distinct o_orderstatus s from orders), (values (0.05), (0.1), (0.5), (1.0)) x(c0), (values (10), (15), (20), (30)) y(k), lateral (select c0::double c) where k <= 20""")
def parameter_grid(t: Tables) -> DataFrame:
    values = lambda name, xs: t.spark.createDataFrame([(x,) for x in xs], f"{name} {'double' if isinstance(xs[0], float) else 'int'}")
    return rel.grid(t.orders.select(F.col("o_orderstatus").alias("s")).distinct(), values("c", [0.05, 0.1, 0.5, 1.0]), values("k", [10, 15, 20, 30])).filter("k <= 20")


@query("u01_union_by_name", "select c_custkey k, c_acctbal bal, c_mktsegment seg from customer union all select s_suppkey, s_acctbal, null from supplier")
def union_by_name(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k")), allowMissingColumns=True)


@query("u02_upsert", """select o_custkey k, max(o_totalprice) v from orders where o_orderstatus = 'F' group by 1 union all select o_custkey, max(o_totalprice) from orders
  where o_orderstatus = 'O' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F') group by 1""")
def upsert(t: Tables) -> DataFrame:
    part = lambda s: t.orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return rel.upsert(part("O"), part("F"), ["k"])


@query("u03_id_sets", """with a as (select distinct o_custkey k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey k from orders where o_orderstatus = 'O')
  select 'union' op, count(*)::bigint n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b)
  union all select 'except', count(*) from (select * from a except select * from b)""")
def id_sets(t: Tables) -> DataFrame:
    part = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey")
    a, b = part("F"), part("O")
    sets = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, d in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u04_coverage_gaps", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def coverage_gaps(t: Tables) -> DataFrame:
    return rel.missing_keys(t.documents, t.labels, ["doc_id"])


@query("u05_grid_completeness", """select s_nationkey nation, p.part_size from (select distinct s_nationkey from supplier), (select distinct p_size part_size from part) p
  where (s_nationkey, p.part_size) not in (select distinct s_nationkey, p_size from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey where l_quantity > 45)""")
def grid_completeness(t: Tables) -> DataFrame:
    want = rel.grid(t.supplier.select(F.col("s_nationkey").alias("nation")).distinct(), t.part.select(F.col("p_size").alias("part_size")).distinct())
    got = t.lineitem.filter("l_quantity > 45").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rel.missing_keys(want, got.select(F.col("s_nationkey").alias("nation"), F.col("p_size").alias("part_size")), ["nation", "part_size"])


@query("o01_typed_order", "select o_orderstatus, o_orderpriority, n, row_number() over (order by n desc, o_orderstatus, o_orderpriority)::int place from (select o_orderstatus, o_orderpriority, count(*)::bigint n from orders group by all)")
def typed_order(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.select("*", F.row_number().over(Window.orderBy(F.col("n").desc(), "o_orderstatus", "o_orderpriority")).alias("place"))


@query("o02_top_report", "select o_custkey, sum(o_totalprice)::decimal(38,2)::double total, count(*)::bigint n from orders group by 1 order by total desc, o_custkey limit 10")
def top_report(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    return rel.top(per, 10, ["total"], ["o_custkey"])


@query("o03_top_by_weight", """select feature, w, place from (select p_type feature, w, row_number() over (order by abs(w) desc, p_type desc)::int place from
  (select p_type, round(corr(p_size, p_retailprice), 6) w from part group by 1)) where place <= 4""")
def top_by_weight(t: Tables) -> DataFrame:
    w = t.part.groupBy(F.col("p_type").alias("feature")).agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("w"))
    return w.select("*", F.row_number().over(Window.orderBy(F.abs("w").desc(), F.col("feature").desc())).alias("place")).filter("place <= 4")


@query("o04_top_base_models", """select m, auc, rank from (select o_orderpriority m, round(coalesce(avg(case when o_orderstatus <> 'P' then o_totalprice end), -1), 3) auc,
  row_number() over (order by coalesce(avg(case when o_orderstatus <> 'P' then o_totalprice end), -1) desc, o_orderpriority)::int rank from orders group by 1) where rank <= 4""")
def top_base_models(t: Tables) -> DataFrame:
    scored = t.orders.groupBy(F.col("o_orderpriority").alias("m")).agg(F.coalesce(F.avg(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), F.lit(-1.0)).alias("v"))
    ranked = scored.select("m", F.round("v", 3).alias("auc"), F.row_number().over(Window.orderBy(F.col("v").desc(), "m")).alias("rank"))
    return ranked.filter("rank <= 4")


@query("o05_positive_cap", """select l_suppkey, l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_suppkey order by l_discount desc,
  md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey, l_quantity) n from lineitem) where n <= 20""")
def positive_cap(t: Tables) -> DataFrame:
    key = F.concat_ws("|", F.lit("7"), "l_orderkey", "l_linenumber", "l_partkey")
    kept = capped(t.lineitem, ["l_suppkey"], 20, [F.col("l_discount").desc(), F.md5(key), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("o06_metric_sheet", """select task, model, auc, row_number() over (order by task, auc desc nulls last, model)::int place from (select o_orderstatus task, o_orderpriority model,
  case when o_orderpriority = '5-LOW' then null else round(avg(o_totalprice), 3) end auc from orders group by o_orderstatus, o_orderpriority)""")
def metric_sheet(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("_v"))
    m = m.select("task", "model", F.when(F.col("model") != "5-LOW", F.round("_v", 3)).alias("auc"))
    return m.select("*", F.row_number().over(Window.orderBy("task", F.col("auc").desc_nulls_last(), "model")).alias("place"))


@query("o07_selected_features", """select feature, sum(n)::bigint freq, round(avg(r), 6) mean_rank from (select *, row_number() over (partition by f order by n desc, feature)::double r from
  (select l_returnflag f, p_type feature, count(*) n from lineitem join part on l_partkey = p_partkey group by all)) group by 1 order by freq desc, mean_rank, feature limit 5""")
def selected_features(t: Tables) -> DataFrame:
    n = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_returnflag", F.col("p_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.col("n").desc(), "feature")))
    per = r.groupBy("feature").agg(F.sum("n").alias("freq"), F.round(F.avg("r"), 6).alias("mean_rank"))
    return per.orderBy(F.col("freq").desc(), "mean_rank", "feature").limit(5)
