"""Mixing sources to target weights by a low-discrepancy schedule.

Targets come from weights, an overall share and a cap on repeats, by water
filling. Van der Corput points (bit-reversed slot numbers) are mapped through
the sources' cumulative weights, slots are ranked inside each source, and slot
rank r takes the r-th equal-token block of that source's shuffled documents,
laid end to end and repeated. Ranks and offsets are two-level prefix sums, so a
source with a third of all rows is summed by many tasks.

Cases: sources are ordered by code point, null last and a source of its own; a
document without words has size 0, and takes part with no words; sources without
words have target 0; equal rows are interchangeable; columns but id, source and size
aren't read; an empty table gives no rows. Every source takes exactly the whole part
of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Slots are ranked, and documents laid end to end, in pieces of about this many rows.
CHUNK = 4096
#: Cells of the grid that maps points to sources by an equality join.
CELLS = 4096


def targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], repeats: int) -> DataFrame:
    """One row a source: ``sidx`` in code-point order, ``weight`` and ``target``.

    sources: columns source and source_size. share: a fraction (3, 2) of the sum of all sizes.
    A source is full when its cap is at most its part of what smaller caps leave.
    """
    up, down = share
    ordered = sources.withColumn("sidx", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    weighed = ordered.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), F.col("sidx") % len(weights) + 1).cast("long"))
    num = lambda c: c.cast("decimal(38,0)")
    sized = (
        weighed.withColumn("_cap", num(F.col("source_size") * repeats * down))
        .withColumn("_all", num(F.sum("source_size").over(Window.partitionBy()) * up))
        .withColumn("_w", F.sum("weight").over(Window.partitionBy()))
    )
    ratio = F.col("_cap").cast("double") / F.col("weight")
    earlier = Window.orderBy(ratio).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(ratio)
    before = lambda c: F.sum(c).over(earlier) - F.sum(c).over(same)
    full = num(F.col("_cap")) * num(F.col("_w") - before("weight")) <= num(F.col("_all") - before("_cap")) * num(F.col("weight"))
    marked = sized.withColumn("_full", full)
    left = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(Window.partitionBy())
    rest = F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(num(F.lit(0)))).over(Window.partitionBy())
    part = (rest * F.col("weight")).cast("double") / (left * down).cast("double")
    return marked.withColumn("target", F.when(F.col("_full"), (F.col("source_size") * repeats).cast("double")).otherwise(part)).select(
        "source", "sidx", "source_size", "weight", "target"
    )


def radical_inverse(slot: Column) -> Column:
    """Van der Corput's point for a slot below 2^62: its bits in reverse, as a number from 0 to 1."""
    x = slot.cast("long")
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        low = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(low), width).bitwiseOR(F.shiftrightunsigned(x, width).bitwiseAND(low))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 1).cast("double") / F.lit(float(1 << 63))


def schedule(quotas: DataFrame) -> DataFrame:
    """Slots in their order: ``slot``, ``sidx`` and ``rank`` inside the source, below the source's ``blocks``.

    quotas: sidx and blocks. Of 2^m points, at least twice the slots needed, every
    stretch of the cumulative weights holds its share, so no source runs short.
    """
    spark = quotas.sparkSession
    ahead = Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, -1)
    n = int(quotas.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])
    if not n:
        return quotas.select(F.lit(0).cast("long").alias("slot"), "sidx", F.lit(0).cast("long").alias("rank")).limit(0)
    points = 1 << (2 * n - 1).bit_length()
    spans = quotas.filter("blocks > 0").withColumn("_lo", F.coalesce(F.sum("blocks").over(ahead), F.lit(0)) / F.lit(float(n)))
    spans = spans.withColumn("_hi", F.when(F.lead("_lo").over(Window.orderBy("sidx")).isNull(), 1.0).otherwise(F.lead("_lo").over(Window.orderBy("sidx"))))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1)).cast("int")
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    tasks = min(max(1, points // (1 << 18)), 100_000)
    drawn = spark.range(0, points, 1, tasks).withColumn("_u", radical_inverse(F.col("id"))).withColumn("_cell", cell(F.col("_u")))
    mapped = drawn.join(spans, "_cell").filter("_u >= _lo and _u < _hi").select(F.col("id").alias("slot"), "sidx", "blocks", F.floor(F.col("id") / CHUNK).cast("long").alias("_chunk"))
    counts = mapped.groupBy("sidx", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("sidx", "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy("sidx").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("sidx", "_chunk").orderBy("slot")) - 1
    return mapped.withColumn("_in", inside).join(offsets, ["sidx", "_chunk"]).withColumn("rank", F.col("_ahead") + F.col("_in")).filter("rank < blocks").select("slot", "sidx", "rank")


def lines(docs: DataFrame, key: str, size: str) -> DataFrame:
    """docs with ``_at``: where each document begins when its source's documents lie end to end, in the order of ``key`` (hexadecimal)."""
    per = docs.groupBy("sidx").agg(F.count(F.lit(1)).alias("_rows"))
    # The sources' row counts fix how finely the keys of each are cut; a power of two keeps the cuts in the keys' order.
    bits = F.least(F.lit(28), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_rows") / CHUNK))))).cast("int")
    cut = docs.join(per.select("sidx", bits.alias("_bits")), "sidx").withColumn("_chunk", F.expr(f"shiftright(cast(conv(substr({key}, 1, 7), 16, 10) as int), 28 - _bits)"))
    cut = settled(cut.drop("_bits").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism))
    sums = cut.groupBy("sidx", "_chunk").agg(F.sum(size).alias("_sum"))
    ahead = Window.partitionBy("sidx").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sidx", "_chunk", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("sidx", "_chunk").orderBy(key, size)
    placed = cut.withColumn("_in", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_nth", F.row_number().over(inside))
    return placed.join(offsets, ["sidx", "_chunk"]).withColumn("_at", F.col("_ahead") + F.col("_in")).drop("_ahead", "_in")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), repeats: int = 2, block_words: int = 1024, seed: str = "mix",
) -> DataFrame:
    """One row a document: id, source, size, ``source_size``, ``target``, ``taken`` words and ``copies``.

    copies: how often the document's first word is taken, which is how often a
    mix of whole documents holds it. Only ids, sources and sizes are shuffled.
    """
    narrow = settled(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size"), F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))).alias("_key")))
    goals = settled(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats).withColumn("_goal", F.floor("target").cast("long")))
    slots = schedule(goals.select("sidx", F.ceil(F.col("_goal") / block_words).cast("long").alias("blocks")))
    own = narrow.join(goals, narrow["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    laid = lines(own, "_key", "size")
    first = lambda at: F.floor(at / block_words).cast("long")
    reach = F.greatest(F.col("size"), F.lit(1)) - 1
    begin = F.col("_at") + F.col("_epoch") * F.col("source_size")
    rows = laid.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_from", begin).withColumn("rank", F.explode(F.sequence(first(F.col("_from")), first(F.col("_from") + reach))))
    upto = F.least(F.col("_from") + F.col("size"), (F.col("rank") + 1) * block_words, F.col("_goal"))
    since = F.greatest(F.col("_from"), F.col("rank") * block_words)
    held = F.col("slot").isNotNull()
    joined = rows.join(slots, ["sidx", "rank"], "left")
    starts = held & (F.col("_from") >= F.col("rank") * block_words) & (F.col("_from") < F.col("_goal"))
    return (
        joined.groupBy("sidx", "_chunk", "_nth", "id", "source", "size", "source_size", "target")
        .agg(F.sum(F.when(held, F.greatest(upto - since, F.lit(0))).otherwise(0)).cast("long").alias("taken"), F.sum(starts.cast("int")).cast("int").alias("copies"))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("size").alias(size_col), "source_size", "target", "taken", "copies")
    )
