"""Sources, sinks, streams and reports (S01 to S19, R02 to R11) on round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import reasons
from ..operators.relational import one_to_one
from ..operators.sampling import draw, folds, nested_folds
from ..session import shared_path
from ..sources import tables, volumes
from ..streaming import resume
from .registry import Tables, query


@query("s01_csv_scan", "select c_custkey::varchar id, c_acctbal bal, c_mktsegment seg from customer")
def csv_scan(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "table") + ".csv"
    t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")).write.option("header", True).csv(path)
    return tables.scan(t.spark, path, "id")


@query("s02_atomic_table", "select o_orderstatus, o_orderkey, o_totalprice from orders")
def atomic_table(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "table") + ".parquet"
    tables.publish(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return tables.scan(t.spark, path).select("o_orderstatus", "o_orderkey", "o_totalprice")


@query("s03_strict_features", "select c_custkey::varchar case_id, c_acctbal from customer")
def strict_features(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "features") + ".parquet"
    tables.publish(t.customer.select(F.format_string(" %d ", "c_custkey").alias("case_id"), "c_acctbal"), path)
    return tables.features(t.spark, path)


@query("s04_label_dimension", "select 'k' || (c_custkey % 200) case_id, min_by(c_mktsegment, c_custkey) seg from customer where c_custkey % 200 > 0 group by 1")
def label_dimension(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 200
    raw = t.customer.orderBy("c_custkey").select(F.when(k == 0, " nan ").otherwise(F.concat(F.lit(" k"), k.cast("string"))).alias(" Case_ID "), F.col("c_mktsegment").alias("SEG"))
    return tables.labels(raw, ["case_id", "seg"])


@query("s05_sheets", """select 'nation' sheet, n_nationkey::bigint id, n_name text, null::double v from nation
  union all select 'balances', c_custkey, null, round(c_acctbal / 7, 4) from customer""")
def sheets(t: Tables) -> DataFrame:
    """Two sheets published as one unit over an older one, with four decimal places; a sheet that isn't there has no rows."""
    path = shared_path(t.spark, "book")
    made = {"nation": t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("text")), "balances": t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 7).alias("v"))}
    tables.write_sheets(path, {"nation": made["nation"].filter("id < 3"), "absent": made["nation"]})
    tables.write_sheets(path, made, places=4)
    schemas = {name: df.schema for name, df in made.items()} | {"absent": made["nation"].schema}
    parts = [tables.read_sheet(t.spark, path, name, kind).withColumn("sheet", F.lit(name)) for name, kind in schemas.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


_FOLD = "(row_number() over (partition by quality order by md5('{0}|' || doc_id), doc_id) - 1) % 4"


@query("s07_split_documents", f"with o as (select doc_id, quality, ({_FOLD.format(42)})::int own from labels), n as (" + " union all ".join(
    f"select doc_id, {k} outer_fold, ({_FOLD.format(42 + k)})::int inner_fold from o where own <> {k}" for k in range(4)) + """)
  select outer_fold, null::int inner_fold, doc_id::varchar case_id, 'train' "role" from n union all select own, null, doc_id::varchar, 'test' from o
  union all select n.outer_fold, r.k::int, n.doc_id::varchar, case when n.inner_fold = r.k then 'inner_val' else 'inner_train' end from n, range(4) r(k)""")  # fmt: skip
def split_documents(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "splits")
    own = folds(t.labels.select("doc_id", "quality"), ["quality"], 4, [draw(42, "doc_id"), "doc_id"], "outer_fold")
    build = lambda: tables.split_documents(nested_folds(t.labels, "doc_id", ["quality"], 4, 4, 42), own, "doc_id")
    return tables.split_table(tables.read_or_build_splits(t.spark, path, build))


@query("s08_keep_list", "select p_type block, p_brand feature from part group by 1, 2")
def keep_list(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "keep")
    per = t.part.groupBy("p_type").agg(F.collect_set("p_brand").alias("f"))
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "f")))).alias("value")).write.text(path)
    return tables.keep_list(t.spark, path)


def stacks(t: Tables) -> DataFrame:
    """Four vectors as the slices of one 4 x 8 x 8 volume."""
    z = (F.col("vec_id") % 4).cast("int").alias("z")
    return t.embeddings.select(F.floor(F.col("vec_id") / 4).cast("string").alias("case_id"), z, F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(3.0).alias("sz"), F.lit(0.5).alias("sy"), F.lit(0.5).alias("sx"), F.col("embedding").alias("v"))


@query("s09_volume_round_trip", """select (vec_id // 4)::varchar case_id, (vec_id % 4)::int z, ((i - 1) // 8)::int y, ((i - 1) % 8)::int x, round(embedding[i]::double, 6) v from embeddings, range(1, 65) r(i)""")
def volume_round_trip(t: Tables) -> DataFrame:
    packed = volumes.encoded(stacks(t))
    return volumes.voxels(volumes.scan(packed)).select("case_id", "z", "y", "x", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("s10_case_discovery", "select distinct 'n' || n_nationkey case_id from nation")
def case_discovery(t: Tables) -> DataFrame:
    folder = shared_path(t.spark, "cases")
    for suffix in ("mask", "image"):
        t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("stem"), F.col("n_name").alias("value")).write.partitionBy("stem").text(f"{folder}/{suffix}")
    found = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", "stem=([^/]+)/", 1).alias("case_id"))
    return found.distinct()


@query("s11_volume_placement", """with c as (select distinct vec_id // 4 c from embeddings)
  select c::varchar case_id, c / 8.0::double ox, 1 - c::double oy, 0.1::double oz, (c % 2 = 0)::int::double xx, (c % 2 = 0)::int - 1::double xy, (c % 2)::double yx, 1.0::double zz from c""")
def volume_placement(t: Tables) -> DataFrame:
    """Cropped volumes that are written with their own origins, every second one turned by a right angle, and read again."""
    c = F.col("case_id").cast("long")
    turned = F.array(*(F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)))
    straight = F.array(*(F.lit(v) for v in volumes.NOWHERE[1]))
    placed = stacks(t).withColumns({"origin": F.array(c / 8, 1 - c.cast("double"), F.lit(0.1)), "direction": F.when(c % 2 == 0, straight).otherwise(turned)})
    path = shared_path(t.spark, "volumes")
    volumes.encoded(placed).write.parquet(path)
    origin = [F.col("origin")[k].alias(n) for k, n in enumerate(("ox", "oy", "oz"))]
    direction = [F.col("direction")[k].alias(n) for k, n in ((0, "xx"), (1, "xy"), (3, "yx"), (8, "zz"))]
    return volumes.scan(t.spark.read.parquet(path)).select("case_id", *origin, *direction).distinct()


@query("s11_voxel_origin", "select c_custkey, round(1 + c_nationkey * 0.5::double, 6) ox, round(2 + (c_custkey % 7) * 3.0::double, 6) oy from customer")
def voxel_origin(t: Tables) -> DataFrame:
    index = F.array(F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 7).cast("double"))
    eye = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    made = t.customer.select("c_custkey", volumes.origin(F.array(F.lit(1.0), F.lit(2.0)), index, F.array(F.lit(0.5), F.lit(3.0)), eye).alias("o"))
    return made.select("c_custkey", F.round(F.col("o")[0], 6).alias("ox"), F.round(F.col("o")[1], 6).alias("oy"))


@query("s12_detection_bag", "select vec_id, round(embedding[1], 6) cs, case when vec_id % 9 = 0 then 0 else round(embedding[2], 6) end pz from embeddings")
def detection_bag(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.col("embedding")[0].alias("cs"))
    b = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 9 == 0, float("nan")).otherwise(F.col("embedding")[1]).cast("float").alias("pz"))
    return volumes.detections([a, b], ["vec_id"], ["cs", "pz"]).select("vec_id", F.round("cs", 6).alias("cs"), F.round("pz", 6).alias("pz"))


@query("s14_resumed_append", "select event_id, user_id, value from events")
def resumed_append(t: Tables) -> DataFrame:
    """A stream over the events, run twice, into a sink that already holds a part of them."""
    path, checkpoint = shared_path(t.spark, "sink"), shared_path(t.spark, "progress")
    rows = t.events.select("event_id", "user_id", "value")
    resume.append_missing(rows.filter("event_id % 3 = 0"), path, "event_id")
    source = shared_path(t.spark, "source")
    rows.write.parquet(source)
    for _ in range(2):
        resume.resume_stream(t.spark.readStream.schema(rows.schema).parquet(source), path, checkpoint, "event_id")
    return resume.published(t.spark, path, rows.schema)


@query("s15_sorted_csv", "select c_mktsegment seg, c_custkey::varchar k from customer")
def sorted_csv(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "sorted")
    tables.write_sorted(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg")), path, ["seg", "k", "absent"], ["seg", "k"])
    return t.spark.read.option("header", True).csv(path)


@query("s16_geometry_report", "select c_mktsegment case_id, round(max(c_acctbal), 4) size, round(min(c_acctbal), 4) low from customer group by 1 union all select 'AVERAGE', round(avg(a), 4), round(avg(b), 4) from (select max(c_acctbal) a, min(c_acctbal) b from customer group by c_mktsegment)")
def geometry_report(t: Tables) -> DataFrame:
    g = t.customer.groupBy(F.col("c_mktsegment").alias("case_id")).agg(F.max("c_acctbal").alias("size"), F.min("c_acctbal").alias("low"))
    return tables.geometry_report(g, "case_id", ["size", "low"]).select("case_id", F.round("size", 4).alias("size"), F.round("low", 4).alias("low"))


@query("s17_text_report", "select 0 line, 'orders' \"text\" union all select (row_number() over (order by n desc, k))::int, 'k=' || k || '  n=' || n from (select o_custkey k, count(*) n from orders group by 1 order by n desc, k limit 10)")
def text_report(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return tables.report_lines(n, "orders", ["n"], ["k"])


@query("s19_first_layout", "select n_nationkey k, n_name balanced_acc from nation")
def first_layout(t: Tables) -> DataFrame:
    new, old = shared_path(t.spark, "new"), shared_path(t.spark, "old")
    t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("bal_acc")).write.parquet(old)
    return tables.first_layout(t.spark, [new, old], t.nation.schema, {"bal_acc": "balanced_acc"})


@query("g01_resample", """with a as (select i::int i, i * 0.8::double / 0.5::double p from range(5) r(i)), g as (select i, floor(p)::int lo, p - floor(p) f from a),
  w as (select i, lo at_, 1 - f w from g union all select i, least(lo + 1, 7), f from g)
  select (vec_id // 4)::varchar case_id, (vec_id % 4)::int z, u.i y, v.i x, round(sum(u.w * v.w * embedding[u.at_ * 8 + v.at_ + 1]::double)::float::double, 5) v from embeddings, w u, w v group by vec_id, u.i, v.i""")
def resample(t: Tables) -> DataFrame:
    """Layers on a grid of 0.8 mm in place of 0.5: five by five cells, each between four old ones."""
    made = volumes.voxels(volumes.resampled(stacks(t), (3.0, 0.8, 0.8)))
    return made.select("case_id", "z", "y", "x", F.round(F.col("v").cast("double"), 5).alias("v"))


@query("r02_valid_results", "select 'same' what, true ok union all select 'less', false union all select 'aligned', true")
def valid_results(t: Tables) -> DataFrame:
    full = t.orders.select("o_orderkey")
    told = {"same": resume.complete(full, full, ["o_orderkey"]), "less": resume.complete(full.filter("o_orderkey > 5"), full, ["o_orderkey"]), "aligned": not one_to_one(full, full, ["o_orderkey"]).isEmpty()}
    return t.spark.createDataFrame(list(told.items()), "what string, ok boolean")


@query("r06_outcomes", """with r as (select l_orderkey k, avg((l_quantity > 2)::int) >= 0.95 a, avg((l_tax > 0)::int) >= 0.95 b from lineitem group by 1), x as (select k, case when a and b then 'kept' else 'filtered' end status, unnest(case when a and b then [null] when a then ['tax'] when b then ['quantity'] else ['quantity', 'tax'] end) reason from r)
  select status, reason, count(*)::bigint n from x group by all""")
def outcomes(t: Tables) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    r = t.lineitem.groupBy("l_orderkey").agg(share(F.col("l_quantity") > 2).alias("a"), share(F.col("l_tax") > 0).alias("b"))
    why = r.withColumn("why", reasons({"quantity": (F.col("a"), 0.95), "tax": (F.col("b"), 0.95)}))
    return resume.outcomes(why.withColumn("status", F.when(F.size("why") == 0, "kept").otherwise("filtered")), "status", "why")


@query("r11_fold_report", """with f as (select (o_custkey % 4)::int fold, avg((o_orderstatus = 'F')::int) * 100 v from orders group by 1) select fold::varchar fold, round(v, 4) v from f union all select 'mean', round(avg(v), 4) from f union all select 'std', round(stddev_pop(v), 4) from f""")
def fold_report(t: Tables) -> DataFrame:
    f = t.orders.groupBy((F.col("o_custkey") % 4).cast("string").alias("fold")).agg((F.avg((F.col("o_orderstatus") == "F").cast("int")) * 100).alias("v"))
    totals = f.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).unpivot([], ["mean", "std"], "fold", "v")
    return f.unionByName(totals).select("fold", F.round("v", 4).alias("v"))
