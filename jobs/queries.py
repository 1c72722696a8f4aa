"""The jobs as queries: each runs twice into one new folder, and gives the whole output as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_path
from jobs import common, feature_book, score_ledger


def job1_feature_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature book's three tables, told apart by ``part``."""
    path, settings = shared_path(spark, "feature_book"), common.config(feature_book.NAME)
    for _ in range(2):
        feature_book.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", path, settings)
    made = {name: feature_book.read(spark, path, name) for name in ("cases", "scales", "book")}
    for name, inexact in (("cases", feature_book.FEATURES), ("scales", ("mean", "std", "difference"))):
        made[name] = made[name].withColumns({f: F.round(f, settings["places"]) for f in inexact})
    parts = [df.withColumn("part", F.lit(name)) for name, df in made.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def job2_score_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger, details and rejected rows, told apart by ``part``."""
    # A stream takes a folder or a pattern; this one is the table, be it a file or a folder.
    path, scores = shared_path(spark, "score_ledger"), f"{sf_dir}/events.parque[t]"
    for _ in range(2):
        score_ledger.run(spark, scores, path)
    made = score_ledger.read(spark, scores, path)
    # A batch's number depends on how many files there are.
    parts = [made[name].withColumn("part", F.lit(name)).drop("batch") for name in ("ledger", "detail", "rejected")]
    whole = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return whole.withColumn("day", F.col("day").cast("string")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


QUERIES = {f.__name__: f for f in (job1_feature_book, job2_score_ledger)}

_RAW = {
    "log_chars": "ln(1 + length(t)::double)",
    "log_words": "ln(1 + w::double)",
    "bytes_per_char": "strlen(t)::double / nullif(length(t), 0)",
    "word_chars": r"(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::double / nullif(w, 0)",
    "line_words": r"w::double / (len(regexp_extract_all(t, '\n')) + 1)",
    "distinct_words": "len(list_distinct(ws))::double / nullif(w, 0)",
    "digits": "len(regexp_extract_all(t, '[0-9]'))::double / nullif(length(t), 0)",
    "capitals": "len(regexp_extract_all(t, '[A-Z]'))::double / nullif(length(t), 0)",
    "marks": r"len(regexp_extract_all(t, '[!-/:-@\[-`{-~]'))::double / nullif(length(t), 0)",
}
_SCALE = """count({f}) {f}_n, avg({f}) {f}_m, stddev_pop({f}) {f}_s, case when count({f}) filter (label = 1) >= 3 and count({f}) filter (label = 0) >= 3
  and var_samp({f}) filter (label = 1) + var_samp({f}) filter (label = 0) > 0
  then (avg({f}) filter (label = 1) - avg({f}) filter (label = 0)) / sqrt((var_samp({f}) filter (label = 1) + var_samp({f}) filter (label = 0)) / 2) end {f}_d"""
_KEY = "case when lower(trim({0})) in ('', 'nan', 'none', 'null', '<na>', 'na') then null else trim({0}) end"

ORACLE = {
    "job1_feature_book": rf"""
with d as (select {_KEY.format("doc_id::varchar")} case_id, text t, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws, len(ws) w from documents),
f as (select case_id, {", ".join(f"{sql} {name}" for name, sql in _RAW.items())} from d where case_id is not null),
o as (select * from f qualify row_number() over (partition by case_id order by {", ".join(f"{name} nulls last" for name in _RAW)}) = 1),
l as (select {_KEY.format("doc_id::varchar")} case_id, max(case when lower(trim(quality::varchar)) in ('true', '1', 'yes', 'y', 't') then 1
  when lower(trim(quality::varchar)) in ('false', '0', 'no', 'n', 'f') then 0 end) label from labels group by 1),
k as (select o.*, label from o left join l using (case_id)),
c as (select *, case when label is null then -1 else ((row_number() over (partition by label order by md5('42|' || case_id), case_id) - 1) % 4)::int end fold from k),
b as (select c.*, r.outer_fold::int outer_fold, case when fold < 0 then 'apply' when fold = r.outer_fold then 'test' else 'train' end role from c, range(4) r(outer_fold)),
m as (select outer_fold, {", ".join(_SCALE.format(f=name) for name in _RAW)} from b where role = 'train' group by 1),
g as ({" union all ".join(f"select '{name}' feature, {name}_n n, {name}_m mean, {name}_s std, {name}_d difference, outer_fold from m" for name in _RAW)})
select 'cases' part, case_id, label, {", ".join(f"round({name}, 6) {name}" for name in _RAW)}, fold, null::int outer_fold, null role,
  null feature, null::bigint n, null::double mean, null::double std, null::double difference from c
union all select 'book', case_id, label, {", ".join(f"round(coalesce(case when {name}_s > 0 then ({name} - {name}_m) / {name}_s end, 0), 6)" for name in _RAW)}, null, outer_fold, role,
  null, null, null, null, null from b join m using (outer_fold)
union all select 'scales', null, null, {", ".join("null" for _ in _RAW)}, null, outer_fold, null, feature, n, round(mean, 6), round(std, 6), round(difference, 6) from g""",
    "job2_score_ledger": """
with n as (select *, concat_ws(', ', case when event_id is null then 'no score_id' end, case when ts is null then 'no ts' end, case when user_id is null then 'no case_id' end) reasons from events),
e as (select event_id score_id, ts, user_id case_id, event_type channel, value score, ts::date as day from n where reasons = ''),
u as (select * replace (case when isfinite(score) then score end as score) from e qualify row_number() over (partition by day, score_id order by ts, case_id, channel nulls last, score nulls last) = 1),
b as (select *, row_number() over (partition by day, case_id, channel order by score desc nulls last, score_id) place from u)
select 'ledger' part, case_id, channel, count(*)::bigint taken, count(score)::bigint scored, round(avg(score), 6) mean, round(stddev_pop(score), 6) std, round(min(score), 6) least,
  round(max(score), 6) most, round(avg(score) filter (place <= 3), 6) best_mean, day::varchar as day, null::bigint score_id, null::varchar ts, null::double score, null reasons from b group by case_id, channel, day
union all select 'detail', case_id, channel, null, null, null, null, null, null, null, day::varchar, score_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), score, null from e
union all select 'rejected', user_id, event_type, null, null, null, null, null, null, null, null, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), value, reasons from n where reasons <> ''""",
}
