"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but ids of a fixed width, one document after the other,
each followed by the end-of-document id. Workers look for that id in a block of
tokens at a time and give each block's separators. A prefix scan over the
blocks of a file (the last separator before a block, and how many there were)
stitches documents that run over block boundaries, and yields every document's
number and length.

Cases: a document without tokens counts 0; what follows the last separator is a
last document if it has tokens; bytes that don't fill an id at a file's end are
not a token; an empty file has no document; a file may hold 2 GB, which is what
Spark reads as one. Null texts are empty documents; rows with equal ids are documents
of their own; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode
from .common import ready, settled

BLOCK_TOKENS = 1 << 20


def write(docs: DataFrame, path: str, vocab_path: str, end: int, *, id_col: str = "doc_id", text: str = "text", dtype: str = "<u2") -> DataFrame:
    """Write each partition's documents as a token file below path; returns (id, part, ordinal), what the files themselves don't hold.

    docs must give the same rows in the same partitions and order whenever it is read,
    as a scan of files does; anything else is to be stored first. Spark's text writer
    puts the end-of-document id, as the bytes of a line separator, after each
    document's packed ids, and numbers files by partition.
    """
    coded = encode(docs.select(id_col, text), vocab_path, text, "ids", special=False, dtype=dtype)
    separator = np.array([end], dtype).tobytes().decode("latin-1")
    coded.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("compression", "none").text(path)
    place = F.monotonically_increasing_id()
    return docs.select(F.col(id_col), F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"))


def located(places: DataFrame, found: DataFrame) -> DataFrame:
    """Places with their documents' ``n_tokens``; ValueError if a file doesn't hold as many documents as its partition."""
    numbered = settled(found.withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int")).drop("file"))
    size = lambda df, name: df.groupBy("part").agg(F.count(F.lit(1)).alias(name))
    both = size(places, "a").join(size(numbered, "b"), "part", "full_outer").filter("not (a <=> b)")
    if not both.isEmpty():
        raise ValueError("token files and documents differ in number")
    return places.join(numbered, ["part", "ordinal"])


def separators(tokens: np.ndarray, end: int, block: int = BLOCK_TOKENS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block number, tokens up to the block's end, places of its separators) of each block."""
    for k, at in enumerate(range(0, len(tokens), block)):
        yield k, min(at + block, len(tokens)), np.flatnonzero(tokens[at : at + block] == end) + at


def counts(spark, path: str, end: int, *, dtype: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens): the documents of the token files below path, in each file's order."""
    ready(spark)
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_buffer()
                tokens = np.frombuffer(raw, dtype, raw.size // width)
                for k, upto, found in separators(tokens, end, block):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()]), pa.array([k], pa.int32()), pa.array([upto], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["file", "block", "upto", "ends"]
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    scanned = settled(files.mapInArrow(run, "file string, block int, upto long, ends array<long>"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = scanned.select("file", "block", F.size("ends").alias("_n"), F.array_max("ends").alias("_last"))
    stitched = marks.select("file", "block", F.coalesce(F.max("_last").over(ahead), F.lit(-1)).alias("_before"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_done"))
    lengths = F.zip_with("ends", F.concat(F.array("_before"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), lambda e, p: e - p - 1)
    inner = scanned.filter(F.size("ends") > 0).join(stitched, ["file", "block"]).select("file", "_done", F.posexplode(lengths).alias("_k", "n_tokens")).select("file", (F.col("_done") + F.col("_k")).alias("ordinal"), "n_tokens")
    tails = scanned.groupBy("file").agg(F.max("upto").alias("_all"), F.coalesce(F.max(F.array_max("ends")), F.lit(-1)).alias("_last"), F.sum(F.size("ends")).alias("ordinal"))
    return inner.unionByName(tails.filter("_all > _last + 1").select("file", "ordinal", (F.col("_all") - F.col("_last") - 1).alias("n_tokens")))
