"""Projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.relational import column_pairs, first_rows, without_empty_columns
from .registry import Tables, query

FLAGS = "case when lower(trim({0})) in ('true','1','yes','y','t') then 1 when lower(trim({0})) in ('false','0','no','n','f') then 0 end"


@query("p01_lenient_cast", "select event_id, try_cast(json_extract_string(props, '$.k') as double) k, try_cast(event_type as double) bad from events")
def lenient_cast(t: Tables) -> DataFrame:
    return t.events.select("event_id", clean.number(F.get_json_object("props", "$.k")).alias("k"), clean.number(F.col("event_type")).alias("bad"))


@query("p02_infinity_scrub", "select event_id, case when value < 1 then null else value end v from events")
def infinity_scrub(t: Tables) -> DataFrame:
    spoiled = F.when(F.col("value") < 0.5, float("inf")).when(F.col("value") < 1, float("nan")).otherwise(F.col("value"))
    return t.events.select("event_id", clean.finite(spoiled).alias("v"))


@query("p03_key_clean", """select c_custkey, case when c_custkey % 7 = 0 then null else trim(c_name) end k,
  regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') loose from customer""")
def key_clean(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 14 == 0, " NaN ").when(F.col("c_custkey") % 7 == 0, "<na>").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return t.customer.select("c_custkey", clean.key(raw).alias("k"), clean.loose_key(F.col("c_name")).alias("loose"))


@query("p04_label_parse", f"""with r as (select doc_id, case doc_id % 5 when 0 then ' Yes ' when 1 then 'F' when 2 then toxic::varchar when 3 then 'TRUE' else 'maybe' end raw from labels)
  select doc_id, {FLAGS.format('raw')}::int flag from r""")
def label_parse(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, " Yes ").when(k == 1, "F").when(k == 2, F.col("toxic").cast("string")).when(k == 3, "TRUE").otherwise("maybe")
    return t.labels.select("doc_id", clean.flag(raw).alias("flag"))


@query("p05_zone_parse", """select s_suppkey, case when s_nationkey % 4 = 0 then 'PZ' when s_nationkey % 4 = 1 then 'TZ' when s_nationkey % 4 = 2 then 'PZ' end zone from supplier""")
def zone_parse(t: Tables) -> DataFrame:
    k = F.col("s_nationkey") % 4
    raw = F.when(k == 0, " pz").when(k == 1, "1").when(k == 2, "0").otherwise("unknown")
    return t.supplier.select("s_suppkey", clean.zone(raw).alias("zone"))


def labelled(t: Tables) -> DataFrame:
    """Labels as cases: quality as the positive flag, a zone from the id."""
    k = F.col("doc_id") % 3
    return t.labels.select(F.col("doc_id").alias("case_id"), F.col("quality").alias("y"), F.when(k == 0, "PZ").when(k == 1, "TZ").alias("zone"))


CASES = "with c as (select doc_id case_id, quality y, case doc_id % 3 when 0 then 'PZ' when 1 then 'TZ' end zn from labels) "


@query("p06_three_class", CASES + "select case_id, case when y = 0 then 'FALSE' when y = 1 and zn is not null then 'TRUE_' || zn end cls from c")
def three_class(t: Tables) -> DataFrame:
    return labelled(t).select("case_id", clean.three_class(F.col("y"), F.col("zone")).alias("cls"))


@query("p07_task_view", CASES + """select case_id, 'cs' task, y::int y from c where y is not null union all
  select case_id, 'zone', (zn = 'TZ')::int from c where y = 1 and zn is not null""")
def task_view(t: Tables) -> DataFrame:
    cases = first_rows(labelled(t), ["case_id"], [F.col("y")])
    cs = cases.filter("y is not null").select("case_id", F.lit("cs").alias("task"), F.col("y").cast("int").alias("y"))
    zone = cases.filter("y = 1 and zone is not null").select("case_id", F.lit("zone").alias("task"), (F.col("zone") == "TZ").cast("int").alias("y"))
    return cs.unionByName(zone)


@query("p08_feature_columns", "select c_custkey, c_acctbal from customer")
def feature_columns(t: Tables) -> DataFrame:
    meta = {"c_custkey", "c_nationkey"}
    df = t.customer
    return df.select("c_custkey", *(f.name for f in df.schema if f.name not in meta and f.dataType.typeName() in ("double", "float", "long", "integer")))


@query("p09_prefix_rename", "select l_orderkey case_id, l_linenumber line, l_quantity t2w_quantity__p, l_discount t2w_discount__p from lineitem")
def prefix_rename(t: Tables) -> DataFrame:
    stripped = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), "l_quantity", "l_discount")
    return stripped.withColumnsRenamed({c: f"t2w_{c.removeprefix('l_')}__p" for c in ("l_quantity", "l_discount")})


HALVES = [(f"a{i}", f"b{i}") for i in range(8)]


def halves(t: Tables) -> DataFrame:
    """Two blocks of eight features a vector."""
    return t.embeddings.select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"a{i}") for i in range(8)), *(F.col("embedding")[32 + i].cast("double").alias(f"b{i}") for i in range(8)))


def _pair_sql(op: str) -> str:
    return "select vec_id, " + ", ".join(f"round(embedding[{i + 1}]::double {op} embedding[{33 + i}]::double, 6) f{i}" for i in range(8)) + " from embeddings"


@query("p10_hadamard", _pair_sql("*"))
def hadamard(t: Tables) -> DataFrame:
    made = column_pairs(halves(t), ["vec_id"], [a for a, _ in HALVES], [b for _, b in HALVES], "hada", [f"f{i}" for i in range(8)])
    return made.select("vec_id", *(F.round(f"f{i}", 6).alias(f"f{i}") for i in range(8)))


@query("p10_difference", _pair_sql("-"))
def difference(t: Tables) -> DataFrame:
    made = column_pairs(halves(t), ["vec_id"], [a for a, _ in HALVES], [b for _, b in HALVES], "diff", [f"f{i}" for i in range(8)])
    return made.select("vec_id", *(F.round(f"f{i}", 6).alias(f"f{i}") for i in range(8)))


@query("p11_feature_sets", """select vec_id, 'concat' fset, round(embedding[1]::double, 6) x, round(embedding[33]::double, 6) y from embeddings union all
  select vec_id, 'fusion_dh', round(embedding[1]::double - embedding[33]::double, 6), round(embedding[1]::double * embedding[33]::double, 6) from embeddings""")
def feature_sets(t: Tables) -> DataFrame:
    both = halves(t).select("vec_id", "a0", "b0")
    sets = {"concat": (F.col("a0"), F.col("b0")), "fusion_dh": (F.col("a0") - F.col("b0"), F.col("a0") * F.col("b0"))}
    parts = [both.select("vec_id", F.lit(name).alias("fset"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y")) for name, (x, y) in sets.items()]
    return parts[0].unionByName(parts[1])


@query("p12_empty_columns", "select o_orderkey, o_orderstatus from orders")
def empty_columns(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_orderstatus", F.lit(None).cast("double").alias("blank"), F.when(F.col("o_orderkey") < 0, 1).alias("never"))
    return without_empty_columns(df, ["o_orderkey"])


@query("p13_thresholds", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 s, case when l_returnflag = 'R' then 'zone' else 'cs' end task,
  (l_discount * 10 >= case when l_returnflag = 'R' then 0.45 else 0.5 end)::int pred from lineitem""")
def thresholds(t: Tables) -> DataFrame:
    task = F.when(F.col("l_returnflag") == "R", "zone").otherwise("cs")
    score = F.col("l_discount") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("s"), task.alias("task"), clean.predicted(score, task).alias("pred"))


@query("p14_cross_terms", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * l_tax, 8) cs_pz, round(l_discount * (1 - l_tax), 8) cs_tz from lineitem")
def cross_terms(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_discount") * F.col("l_tax"), 8).alias("cs_pz"), F.round(F.col("l_discount") * (1 - F.col("l_tax")), 8).alias("cs_tz"))


@query("p15_metric_rounding", "select o_custkey, round(stddev_pop(o_totalprice), 4) std_price, count(*)::bigint n from orders group by 1")
def metric_rounding(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.round(F.stddev_pop("o_totalprice"), 4).alias("std_price"), F.count(F.lit(1)).alias("n"))


@query("p16_mean_std_text", """with m as (select o_orderpriority p, round(avg(o_totalprice), 4) a, round(stddev_pop(o_totalprice), 4) s from orders group by 1)
  select p, printf('%.4f', a) || ' ± ' || printf('%.4f', s) txt, a mean, s std from m""")
def mean_std_text(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.col("o_orderpriority").alias("p")).agg(F.round(F.avg("o_totalprice"), 4).alias("a"), F.round(F.stddev_pop("o_totalprice"), 4).alias("s"))
    text = m.withColumn("txt", clean.mean_std_text(F.col("a"), F.col("s"))).withColumn("_p", clean.text_mean_std(F.col("txt")))
    return text.select("p", "txt", F.col("_p.mean").alias("mean"), F.col("_p.std").alias("std"))


@query("p17_literal_columns", "select 'orders' file, 'l1' fs_method, o_orderkey, o_orderstatus from orders")
def literal_columns(t: Tables) -> DataFrame:
    return t.orders.select(F.lit("orders").alias("file"), F.lit("l1").alias("fs_method"), "o_orderkey", "o_orderstatus")


@query("p18_geometry_one_hot", """select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_linenumber / 6.0::double, 6) z,
  (l_returnflag = 'A')::int is_a, (l_returnflag = 'N')::int is_n, (l_returnflag = 'R')::int is_r from lineitem""")
def geometry_one_hot(t: Tables) -> DataFrame:
    hot = [(F.col("l_returnflag") == s).cast("int").alias(f"is_{s.lower()}") for s in "ANR"]
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_linenumber") / F.greatest(F.lit(7 - 1), F.lit(1)), 6).alias("z"), *hot)


@query("p19_quality_reasons", """with r as (select l_orderkey k, avg((l_quantity > 2)::int) a, avg((l_discount > 0.01)::int) b, avg((l_tax > 0)::int) c from lineitem group by 1)
  select k, (case when a >= 0.95 then '' else 'quantity;' end) || (case when b >= 0.8 then '' else 'discount;' end) || (case when c >= 0.95 then '' else 'tax;' end) why from r""")
def quality_reasons(t: Tables) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    r = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(share(F.col("l_quantity") > 2).alias("a"), share(F.col("l_discount") > 0.01).alias("b"), share(F.col("l_tax") > 0).alias("c"))
    why = clean.reasons({"quantity": (F.col("a"), 0.95), "discount": (F.col("b"), 0.8), "tax": (F.col("c"), 0.95)})
    return r.select("k", F.array_join(F.transform(why, lambda x: F.concat(x, F.lit(";"))), "").alias("why"))


@query("p20_active_grid", "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('F', 'O') and o_orderpriority in ('1-URGENT', '2-HIGH')")
def active_grid(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("p21_name_taxonomy", """select p_partkey, case when contains(lower(p_name), 'ring') then 'ring' when contains(lower(p_name), 'gear') or contains(lower(p_name), 'bolt') then 'metal'
  when contains(lower(p_type), 'promo') then 'promo' else 'other' end fam, split_part(p_name, ' ', 1) head from part""")
def name_taxonomy(t: Tables) -> DataFrame:
    text = F.concat_ws("|", "p_name", "p_type")
    rules = (("ring", ("ring",)), ("metal", ("gear", "bolt")), ("promo", ("promo",)))
    return t.part.select("p_partkey", clean.by_rules(text, rules, "other").alias("fam"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"))


_SHOWN = "regexp_replace('s' || (p_size % 5 + 1) || '_' || replace(lower(p_type), ' ', '_') || '_likelihood_smoothed_heatmap_' || case p_size % 4 when 0 then 'mean' when 1 then 'top10_mean' when 2 then 'count_ge_threshold' else 'median' end, '^s([123])_', 'S\\1 ')"
for _part, _text in clean.SHORT:
    _SHOWN = f"replace({_SHOWN}, '{_part}', '{_text}')"


@query("p21_short_names", f"""with s as (select p_partkey, trim(regexp_replace({_SHOWN}, '\\s+', ' ', 'g')) t from part)
  select p_partkey, case when length(t) <= 26 then t else rtrim(t[:25]) || '.' end shown, case when p_partkey % 2 = 0 then 'book' || p_partkey else 'lr||k=' || p_partkey end file from s join part using (p_partkey)""")
def short_names(t: Tables) -> DataFrame:
    """Feature names for display, and the files of candidates' ids."""
    kind = F.when(F.col("p_size") % 4 == 0, "mean").when(F.col("p_size") % 4 == 1, "top10_mean").when(F.col("p_size") % 4 == 2, "count_ge_threshold").otherwise("median")
    name = F.concat(F.lit("s"), (F.col("p_size") % 5 + 1).cast("string"), F.lit("_"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("_likelihood_smoothed_heatmap_"), kind)
    key = F.col("p_partkey").cast("string")
    candidate = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("lr||k=5||feature--book"), key, F.lit(".xlsx"))).otherwise(F.concat(F.lit("lr||k="), key))
    return t.part.select("p_partkey", clean.short_name(name, 26).alias("shown"), clean.file_of(candidate).alias("file"))


@query("p22_parameter_keys", """select p_partkey, '{"k":"' || p_size || '","type":"' || p_type || '"}' params, case when p_size % 3 = 0 then 'off' else '0.' || (p_size % 9 + 1) end pca,
  p_brand || '||' || '{"k":"' || p_size || '","type":"' || p_type || '"}' || '||' || case when p_size % 3 = 0 then 'off' else '0.' || (p_size % 9 + 1) end cid from part""")
def parameter_keys(t: Tables) -> DataFrame:
    params = F.create_map(F.lit("type"), F.col("p_type"), F.lit("k"), F.col("p_size").cast("string"))
    share = F.when(F.col("p_size") % 3 != 0, (F.col("p_size") % 9 + 1) / 10)
    made = t.part.select("p_partkey", "p_brand", clean.sorted_json(params).alias("params"), clean.share_key(share).alias("pca"))
    return made.select("p_partkey", "params", "pca", clean.candidate_id(F.col("p_brand"), F.col("params"), F.col("pca")).alias("cid"))


@query("p23_layout_paths", "select distinct 'experiment=' || o_orderstatus || '/seed=' || (o_custkey % 5) || '/task=' || case when o_orderstatus = 'F' then 'cs' else 'zone' end path from orders")
def layout_paths(t: Tables) -> DataFrame:
    task = F.when(F.col("o_orderstatus") == "F", "cs").otherwise("zone")
    return t.orders.select(F.concat(F.lit("experiment="), "o_orderstatus", F.lit("/seed="), (F.col("o_custkey") % 5).cast("string"), F.lit("/task="), task).alias("path")).distinct()
