"""A training corpus from the documents table, in five stages.

Toxic documents go, documents in no known language go, one document of each
group of near duplicates stays, sources are mixed to their targets by whole
documents, and what is left is encoded. Every stage works on all that the one
before it kept and is written as Parquet in the shared folder; all but the last
return the columns they get.

Cases: null and empty texts have no features, no language and no shingles: they
pass the first stage where the model's bias does, and leave in the second, as
texts without letters do. Very long texts are read whole by each stage. Documents
without an id are never dropped as copies, and each of them is mixed as often as
the commonest of them. In the third stage a document is its id and its text: rows
equal in both are one, and which of them stays doesn't depend on their order; an
id's other texts are judged by themselves. Other columns pass through, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, mixing, neardup, toxicity
from gridloom.llm.common import gathered, scratch, settled, table, unused
from gridloom.llm.queries import TOKENIZER_DIR, TOXIC, word_count

#: A document's language is unknown if fewer of its letter n-grams are known to the best language.
KNOWN_GRAMS = 0.2


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; all labels may be learned from."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    told = unused(docs, "_toxicity")
    return toxicity.score(docs, model, out=told).filter(F.col(told) < TOXIC).select(*docs.columns)


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and whose n-grams a learned language knows; all of them if no language can be learned."""
    filters = langid.learn(docs, F.lit(True))
    if not filters.langs:
        return docs
    lang, known = unused(docs, "_lang"), unused(docs, "_known")
    told = langid.predict(docs, filters, lang_out=lang, score_out=known)
    return told.filter((F.col(lang) != langid.UNDETERMINED) & (F.col(known) >= KNOWN_GRAMS)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more: that with the smallest id."""
    key, rest = unused(docs, "_key"), unused(docs, "_rest")
    # A document is its id and its text: where an id stands for several texts, each is judged by itself.
    named = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text"))))
    told = neardup.cluster(named.filter(F.col(key).isNotNull()), id_col=key, width=5, percent=80)
    told = settled(gathered(told.groupBy(key).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1")))
    left = named.filter(F.col(key).isNotNull()).join(told.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)
    again = told.filter("kept").select(key)
    if not again.isEmpty():
        # Rows equal in id and text: one stays, the same one in any order of rows.
        rows = named.join(again.hint("shuffle_hash"), key, "left_semi").withColumn(rest, F.struct(*docs.columns))
        one = rows.groupBy(key).agg(F.min_by(rest, F.xxhash64(*docs.columns)).alias(rest))
        left = left.unionByName(one.select(*(F.col(rest)[c].alias(c) for c in docs.columns)))
    return left.unionByName(docs.filter("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix of sources takes its first word."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    own, copies, copy = (unused(docs, name) for name in ("_id", "_copies", "_copy"))
    times = mixing.mix(sized).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    taken = docs.join(times.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str, vocab_path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json") -> DataFrame:
    """Each document's ids (packed 32-bit integers), their number, and whether they decode to the text."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), vocab_path), vocab_path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", without_toxic), ("language", in_known_language), ("near copies", without_near_copies), ("mixing", mixed), ("encoding", encoded)]

#: The first stage's classifier is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
