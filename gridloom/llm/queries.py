"""The opN_ queries: thin uses of the operators over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, fim, hnsw, langid, mixing, neardup, pii, sharding, tokenfiles, toxicity, warc
from .common import WORD, scratch, table

TOKENIZER_DIR = "/opt/tokenizers"
SHARDS = 40
TOXIC = 0.7


def word_count(text):
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.links(table(spark, sf_dir, "embeddings"), least=0.9)


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False))
    filters = langid.learn(docs, id_remainder(4) != 2)
    told = langid.predict(docs.select("doc_id", "text"), filters)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixing_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_separator_scan(spark: SparkSession, sf_dir: str, vocab_path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json", end: int = 50256) -> DataFrame:
    """Each document's tokens, counted in flat token files that hold the whole table."""
    path = scratch(spark, "tokens")
    places = tokenfiles.write(table(spark, sf_dir, "documents"), path, vocab_path, end)
    return tokenfiles.located(places, tokenfiles.counts(spark, path, end)).select("doc_id", "n_tokens")


def op6_shard_prefix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shard_by_bytes(docs, ["doc_id", "size", "text_crc32"], "size", SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound, so every row of embeddings is played as a melody."""
    return chroma.group(chroma.recordings(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op9_bpe_rank_array(spark: SparkSession, sf_dir: str, vocab_path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, vocab_path).drop("text"), vocab_path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), id_remainder(3) != 1)
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(id_remainder(3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.transform(docs, out="text").withColumnRenamed("text", "output")
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), mask="text").drop("text")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(pii.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hnsw_shards, op2_language_bitmask, op3_warc_dictionary, op4_mixing_schedule, op5_token_separator_scan, op6_shard_prefix_bytes, op7_odd_sketches, op8_chroma_fingerprints,
        op9_bpe_rank_array, op10_toxicity_nnpu, op11_fill_in_middle, op12_pii_spans,
    )
}


def pii_sql() -> str:
    """Places of all matches from the pieces between them, then the checks, the words nearby and the overlaps."""
    of = {(d.kind, d.base): d for d in pii.DETECTORS}
    patterns = {
        ("email", True): r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        ("ip", True): r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        ("card", True): r"[0-9](?:[\x20-]?[0-9])+",
        ("phone", True): r"\+[0-9][\x20().0-9-]+[0-9]",
    } | {key: d.pattern for key, d in of.items() if not d.base}
    found = " union all ".join(
        f"select rid, t, '{kind}' kind, {pii.KINDS.index(kind)} rank, {base} base, {of[kind, base].prior} prior, regexp_extract_all(t, '{p}') m,"
        f" regexp_split_to_array(t, '{p}') g, '\\b(?:{'|'.join(of[kind, base].words)})\\b' words from d"
        for (kind, base), p in patterns.items()
    )
    lengths = ", ".join(f"'{c}': {n}" for c, n in pii.IBAN_LENGTH.items())
    return rf"""
with d as (select doc_id, row_number() over () rid, coalesce(text, '') t from documents),
f as ({found}),
i as (select *, unnest(range(1, len(m) + 1)) i from f where len(m) > 0),
p as (select rid, t, kind, rank, base, prior, words, m[i] s,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint a from i),
q as (select *, a + length(s) z, regexp_replace(s, '[^0-9]', '', 'g') n, replace(s, ' ', '') bare from p),
c as (select *, case kind
  when 'email' then true
  when 'ip' then list_bool_and(list_transform(string_split(s, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast(right(x, 3) as int), 0) <= 255))
  when 'card' then length(n) between 12 and 19 and list_sum(list_transform(range(1, length(n) + 1), lambda k:
    case when (length(n) - k) % 2 = 1 then [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][n[k]::int + 1] else n[k]::int end)) % 10 = 0
  when 'phone' then not base or length(n) between 9 and 15
  when 'iban' then length(bare) = map {{{lengths}}}[left(bare, 2)] and list_reduce(list_prepend(0::bigint,
    list_transform(range(1, length(bare) + 1), lambda k: (case when k + 4 > length(bare) then bare[k + 4 - length(bare)] else bare[k + 4] end).ascii()::bigint)),
    lambda x, y: case when y < 65 then (x * 10 + y - 48) % 97 else (x * 100 + y - 55) % 97 end) = 1
  when 'ssn' then left(s, 3) not in ('000', '666') and left(s, 3) < '900' and s[5:6] <> '00' and right(s, 4) <> '0000'
  when 'insurance' then 97 - left(bare, 13)::bigint % 97 = right(bare, 2)::int
  when 'dni' then right(s, 1) = '{pii.DNI_LETTERS}'[left(s, 8)::int % 23 + 1] end good,
  substr(t, greatest(a - {pii.WINDOW}, 0) + 1, a - greatest(a - {pii.WINDOW}, 0)) || ' ' || substr(t, z + 1, {pii.WINDOW}) beside,
  (a > 0 and regexp_matches(substr(t, a, 1), '[\pL\pN]')) or regexp_matches(substr(t, z + 1, 1), '[\pL\pN]') tied from q),
r as (select *, prior + case when regexp_matches(translate(beside, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), words) then {pii.NEARBY} else 0 end score
  from c where good and (base or not tied)),
k as (select *, row_number() over () own from r where score >= {pii.LEAST}),
e as (select x.* from k x where x.base or (not exists (from k y where y.rid = x.rid and y.base and y.a <= x.a and y.z >= x.z)
  and not exists (from k y where y.rid = x.rid and not y.base and y.own <> x.own and y.a < x.z and x.a < y.z and (y.score, y.z - y.a, -y.a) > (x.score, x.z - x.a, -x.a)
    and not exists (from k b where b.rid = y.rid and b.base and b.a <= y.a and b.z >= y.z)))),
o as (select rid, {", ".join(f"count(*) filter (base and kind = '{k}') n_{k}" for k in ("email", "ip", "card", "phone"))},
  string_agg(kind || ':' || a || ':' || z, ',' order by a, rank, z) filter (base) b, string_agg(kind || ':' || a || ':' || z, ',' order by a, rank, z) spans from e group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint n_{k}" for k in ("email", "ip", "card", "phone"))},
  sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans from d left join o using (rid)"""

ORACLE: dict[str, str] = {
    "op1_hnsw_shards": r"""
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and list_dot_product(embedding::double[], embedding::double[]) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on l.a = r.b),
c as (select a vec_id, min(b) component_id from r group by 1), n as (select a vec_id, count(*)::bigint n_links from l group by 1)
select vec_id, coalesce(n_links, 0)::bigint n_links, component_id, vec_id = component_id kept from embeddings join c using (vec_id) left join n using (vec_id)""",
    "op3_warc_dictionary": r"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
m as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end lead from p)
select page_id, payload_bytes, payload_digest, case when lead = page_id then 'response' else 'revisit' end record_type,
  case when lead <> page_id then lead end refers_to from m""",
    "op4_mixing_schedule": r"""
with d as (select doc_id, source, md5('mix|' || doc_id) k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::hugeint n, row_number() over (order by source nulls last) - 1 i from d group by source),
w as (select *, [5, 2, 1][(i % 3 + 1)::int]::hugeint w from s),
r as (select *, n * 4 cap, (n * 4)::double / w q, (sum(n) over ()) * 3 whole, sum(w) over () ws from w),
f as (select *, cap * (ws - (sum(w) over (order by q range unbounded preceding) - sum(w) over (partition by q)))
  <= (whole - (sum(cap) over (order by q range unbounded preceding) - sum(cap) over (partition by q))) * w filled from r),
t as (select *, case when filled then (n * 2)::double else ((whole - sum(case when filled then cap else 0 end) over ()) * w)::double
  / ((sum(case when filled then 0 else w end) over ()) * 2)::double end target from f),
l as (select d.*, t.n, t.target, floor(t.target)::hugeint goal,
  coalesce(sum(d.size) over (partition by t.i order by d.k, d.size rows between unbounded preceding and 1 preceding), 0) a
  from d join t on d.source is not distinct from t.source)
select doc_id, size, n::bigint source_size, target,
  (least(greatest(goal - a, 0), size) + least(greatest(goal - n - a, 0), size))::bigint taken from l""",
    "op7_odd_sketches": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) s from w),
n as (select doc_id, count(*)::bigint n from s group by 1),
i as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
h as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
l as (select a, b from h union all select b, a from h),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on l.a = r.b),
c as (select a doc_id, min(b) component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from documents join c using (doc_id) left join n using (doc_id)""",
    "op6_shard_prefix_bytes": r"""
with recursive bits(i, k, v) as (select i, 0, i::bigint from range(256) r(i) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) tab from bits where k = 8),
d as (select doc_id, (strlen(coalesce(text, '')) + 16)::bigint size, hex(encode(coalesce(text, ''))) h from documents),
h as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)::bigint text_crc32 from d, crc),
p as (select *, coalesce(sum(size) over (order by doc_id, size, text_crc32 rows between unbounded preceding and 1 preceding), 0)::hugeint b,
  row_number() over (order by doc_id, size, text_crc32) - 1 i, sum(size) over () whole from h),
c as (select *, least(39, ((b * 2 + size) * 40) // (whole * 2))::int shard from p)
select doc_id, size, text_crc32, 'bytes' law, shard, (i - min(i) over (partition by shard))::bigint slot, null::int grown_shard from c""",
    "op11_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || doc_id) h from documents),
n as (select *, length(t) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from n),
p as (select *, substr(t, 1, a) x, substr(t, a + 1, b - a) y, substr(t, b + 1) z from c)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y when 'spm' then '<S>' || z || '<P>' || x || '<M>' || y else t end) output_sha256,
  sha256(t) restored_sha256 from p""",
    "op12_pii_spans": pii_sql(),
}
