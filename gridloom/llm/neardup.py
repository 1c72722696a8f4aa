"""Near-duplicate documents by banded MinHash with odd sketches.

A document is the set of its word shingles. Equal sets are one node from the
start, named by a 64-bit print; prints that two different sets share are told
apart by further bits. Bands of MinHash samples put similar sets into common
buckets; the samples are also folded into a parity bitmap, the odd sketch
(Mitzenmacher et al., 2014), whose differing bits tell how many samples differ.
A candidate pair whose sketches are far enough apart is dropped without looking
at texts; every other one is confirmed on the full sets.

A bucket of any size costs pairs in proportion to its size: its members are
first compared with one leader, the member with the smallest print, which mostly
leads all buckets of its group. A leader's pairs are dealt into blocks, so that
no task gets all the sketches or sets of a large group, and each block is worked
through as a stream. Where different components then still meet in a bucket,
their members are compared block by block inside tasks, which give no more links
than join components: no link that matters is lost, and no group's pairs are
written out. Blocks are bounded in rows and in bytes of sets.

Cases: ids may be of any type that has an order; a null id stands for no other
row: its document is compared with nothing, has no component and is kept. A text
without words, or a null one, has an empty set and is linked with nothing; a text
with fewer words than a shingle is one shingle; rows with the same id are one
document, whose component is the smallest that any of its texts belongs to;
other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, joined, ready, settled, stored
from .graph import components

ROWS, BANDS = 6, 48
SAMPLES = ROWS * BANDS
SKETCH_BITS = 1024
#: Members, and bytes of their sets, that are compared with each other in one piece of work.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Prints of sets that a task remembers, so as to give an exact copy no bands of its own.
SEEN = 1 << 17
MEMO_WORDS = 100_000

_RNG = np.random.default_rng(20140407)
SALT = _RNG.integers(0, 1 << 32, (SAMPLES, 1), np.uint32)
FACTOR = _RNG.integers(0, 1 << 32, (SAMPLES, 1), np.uint32) | np.uint32(1)
SPREAD = _RNG.integers(0, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
BAND_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


class _Words(dict):
    """64-bit hashes by word; emptied after each task, since idle workers keep what they hold."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The text's distinct shingles as ascending 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        width = len(h)
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : len(h) - width + 1 + k]
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples of a set, worked out a cache-sized piece at a time."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, ((x[at : at + 512] ^ SALT) * FACTOR).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> bytes:
    """The samples folded into a bitmap: each flips the bit that it and its number choose."""
    place = ((least.astype(np.uint64) + np.uint64(1)) * SPREAD) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = ((least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * BAND_MIX).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def most_differing(similarity: float, sigmas: float = 5.0) -> int:
    """Bits in which the sketches of sets with this similarity differ at most, but for chance beyond ``sigmas``.

    Each of the samples that differ flips a bit in either bitmap.
    """
    apart = SAMPLES * (1 - similarity) + sigmas * math.sqrt(SAMPLES * similarity * (1 - similarity))
    share = (1 - (1 - 2 / SKETCH_BITS) ** (2 * min(apart, SAMPLES))) / 2
    return math.ceil(SKETCH_BITS * share + sigmas * math.sqrt(SKETCH_BITS * share * (1 - share)) * 0.5)


def signatures(docs: DataFrame, id_col: str, text: str, width: int, print_bits: int = 64) -> DataFrame:
    """id, ``n_shingles``, ``node`` and ``more`` (64 bits each of the set's print), ``bands`` and ``sketch``.

    An empty set has only its size; a set that its task has met before lacks bands and sketch.
    """
    ready(docs.sparkSession)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("more", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()),
    ])
    mask = np.int64((1 << print_bits) - 1 if print_bits < 64 else -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            n, nodes, more, keys, sketches = [], [], [], [], []
            for t in batch.column(1):
                found = shingles(t.as_py(), width)
                n.append(len(found))
                whole = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                first, second = (None, None) if whole is None else map(int, np.frombuffer(whole, np.int64))
                nodes.append(None if first is None else first & int(mask))
                more.append(second)
                least = None if whole is None or whole in met else samples(found)
                keys.append(None if least is None else band_keys(least))
                sketches.append(None if least is None else odd_sketch(least))
                if least is not None:
                    if len(met) >= SEEN:
                        met.clear()
                    met.add(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(more, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=schema.names,
            )
        _WORDS.clear()

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def told_apart(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed with one node a set, the nodes with their least id ``rep`` and number of rows ``many``).

    Of n sets some n^2 / 2^65 share 64 bits with another: 30,000 of 10^12, few enough to send to every task.
    """
    per = lambda rows: rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"), F.min("more").alias("_lo"), F.max("more").alias("_hi"))
    nodes = stored(gathered(per(signed)), "nodes")
    shared = nodes.filter("_lo <> _hi").select("node", F.lit(True).alias("_shared"))
    if not shared.isEmpty():
        signed = signed.join(F.broadcast(shared), "node", "left").withColumn("node", F.when(F.col("_shared"), F.xxhash64("node", "more")).otherwise(F.col("node"))).drop("_shared")
        nodes = stored(gathered(per(signed)), "nodes")
    return signed, nodes.withColumnRenamed("_lo", "more").drop("_hi")


def beside_leaders(pairs: DataFrame, held: DataFrame, near: Callable[[tuple, tuple], bool]) -> DataFrame:
    """The pairs (a, b, parts) whose rows of held, without the node, are near.

    a's row goes to each of the blocks that its pairs are dealt into by b, and in a
    block it comes first: a task has one leader's row and one batch in memory.
    """
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.col("parts")))
    asked = dealt.select(F.col("b").alias("node"), "a", "parts", "block").unionByName(dealt.select(F.col("a").alias("node"), "a", "parts", "block").distinct())
    rows = asked.join(held, "node").select("a", "parts", "block", "node", *(c for c in held.columns if c != "node"))
    order = ["a", "parts", "block", (F.col("node") != F.col("a")).cast("int"), "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            a, node = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            place = list(zip(a.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            good = np.zeros(len(a), bool)
            for k, values in enumerate(zip(*batch.columns[4:], strict=True)):
                if a[k] == node[k]:
                    # Copied, so that a leader doesn't keep its batch in memory.
                    lead, own = place[k], tuple(v.as_py() for v in values)
                elif lead == place[k]:
                    good[k] = near(own, tuple(v.as_py() for v in values))
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(node[good]), batch.column(1).filter(pa.array(good))], names=["a", "b", "parts"])

    return rows.repartition("a", "parts", "block").sortWithinPartitions(*order).mapInArrow(run, "a long, b long, parts long")


def close_sketches(percent: int, differing: int) -> Callable[[tuple, tuple], bool]:
    """Whether sizes and sketches let two sets reach the similarity."""

    def near(x: tuple, y: tuple) -> bool:
        return min(x[0], y[0]) * 100 >= max(x[0], y[0]) * percent and (int.from_bytes(x[1]) ^ int.from_bytes(y[1])).bit_count() <= differing

    return near


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(node, whole): the full sets, packed, of the wanted nodes; a node may have several equal rows."""
    ready(docs.sparkSession)
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("_id"), "node", "more")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for t, node, more in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node in met:
                    continue
                whole = shingles(t.as_py(), width).tobytes()
                # Another text of the same id has another print.
                if whole and int(np.frombuffer(xxhash.xxh3_128_digest(whole), np.int64)[1]) == more:
                    if len(met) >= SEEN:
                        met.clear()
                    met.add(node)
                    out[0].append(node)
                    out[1].append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["node", "whole"])
        _WORDS.clear()

    # A hash join: texts aren't sorted. The ids are narrow, and dealt as the texts are.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(ids.hint("shuffle_hash"), "_id").select("_text", "node", "more")
    return stored(texts.mapInArrow(sets, "node long, whole binary"), "sets")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def alike(percent: int) -> Callable[[tuple, tuple], bool]:
    """Whether two packed sets have 100 * intersection >= percent * union."""
    return lambda x, y: similar(np.frombuffer(x[0], np.uint64), np.frombuffer(y[0], np.uint64), percent)


#: Components in a bucket beyond which its members are compared with each other, and not each component with what it meets.
CROWD = 8


def open_groups(shared: DataFrame, found: DataFrame, least: int = 3) -> DataFrame:
    """What may still be linked: (kind, key, id, component, side), with kind 0 for members of a bucket and 1 for a component's with what it meets.

    shared: key, id and size of the buckets; found: node and component. In a group of
    kind 0 every two members are to be compared: a bucket's unlinked ones, or all of
    them where more than ``CROWD`` components meet in it. In one of kind 1 the
    component's own members (side 0) with the others (side 1); a meeting of two
    components counts once. So a bucket gives ``CROWD`` rows a member at most.
    Buckets of fewer than ``least`` members are left out.
    """
    placed = shared.filter(F.col("size") >= least).join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), F.col("component").isNotNull().alias("linked"))
    placed = stored(gathered(placed), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_many"))
    mixed = mixed.filter((F.col("_lo") != F.col("_hi")) & (F.col("_many") >= least)).select("key", "_many")
    mixed = settled(gathered(mixed))
    total = mixed.agg(F.sum("_many")).first()[0]
    if not total:
        return placed.limit(0).select(F.lit(0).alias("kind"), "key", "id", "component", F.lit(0).alias("side"))
    rows = stored(gathered(joined(placed, mixed, "key", "_many", total)), "meeting")
    present = rows.filter("linked").select("key", F.col("component").alias("group")).distinct()
    crowded = present.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD).select("key")
    open_rows = rows.join(crowded, "key", "left_anti")
    lonely = open_rows.filter("not linked")
    many = lonely.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    alone = lonely.join(many, "key", "left_semi").unionByName(rows.join(crowded, "key", "left_semi")).select(F.lit(0).alias("kind"), "key", "id", "component", F.lit(0).alias("side"))
    met = open_rows.join(present, "key").filter("(not linked and component <> group) or (linked and component > group)")
    met = met.select(F.lit(1).alias("kind"), F.col("group").cast("long").alias("key"), "id", "component", F.lit(1).alias("side")).distinct()
    own = rows.filter("linked").select("id", "component").distinct().join(met.select(F.col("key").alias("component")).distinct(), "component", "left_semi")
    return alone.unionByName(met).unionByName(own.select(F.lit(1).alias("kind"), F.col("component").cast("long").alias("key"), "id", "component", F.lit(0).alias("side")))


def in_blocks(groups: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(kind, key, _i, _j, side, id, component): a group's sides dealt into blocks, each row once for every two blocks that it is part of.

    groups has each member's ``bytes``; a block has about ``most`` rows and ``most_bytes``
    at most. In a group of kind 0 side tells the second block's rows from the first's.
    """
    left = F.col("side") == 0
    of = lambda here: (F.sum(here.cast("long")), F.sum(F.when(here, F.col("bytes")).otherwise(0)))
    blocks = lambda rows, held: F.greatest(F.lit(1), F.ceil(rows / most), F.ceil(held / most_bytes)).cast("int")
    groups = groups.withColumn("_group", F.concat_ws(":", "kind", "key"))
    sides = settled(gathered(groups.groupBy("_group").agg(blocks(*of(left)).alias("_b0"), blocks(*of(~left)).alias("_b1"), F.count(F.lit(1)).alias("_many"))))
    total = sides.agg(F.coalesce(F.sum("_many"), F.lit(0))).first()[0]
    pair = F.col("kind") == 0
    own = F.pmod(F.xxhash64("id"), F.when(left, F.col("_b0")).otherwise(F.col("_b1"))).cast("int")
    others = F.when(~pair & left, F.col("_b1")).otherwise(F.col("_b0"))
    dealt = joined(groups, sides, "_group", "_many", total).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
    first = F.when(pair, F.least("_own", "_other")).when(left, F.col("_own")).otherwise(F.col("_other"))
    second = F.when(pair, F.greatest("_own", "_other")).when(left, F.col("_other")).otherwise(F.col("_own"))
    side = F.when(pair, (F.col("_own") != first).cast("int")).otherwise(F.col("side"))
    return dealt.select("kind", "key", first.alias("_i"), second.alias("_j"), side.alias("side"), "id", "component")


def group_links(groups: DataFrame, marks: DataFrame, sets: DataFrame, percent: int, differing: int) -> DataFrame:
    """Links (a, b) that join components which meet in a group; no more than there are members.

    A group's sides are dealt into blocks, and each two blocks are compared in one
    task: by sketches first, then, the nearest first, on full sets, until the two
    are in one component.
    """
    held = marks.withColumnRenamed("node", "id").join(sets.withColumnRenamed("node", "id"), "id")
    rows = in_blocks(groups, BLOCK, BLOCK_BYTES).join(held, "id").select("kind", "key", "_i", "_j", "side", "id", "component", "n_shingles", "sketch", "whole")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        kind, _, i, j = (k.as_py() for k in key)
        ids, n, side = (table.column(c).to_numpy() for c in ("id", "n_shingles", "side"))
        root = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("whole")]
        alone = kind == 0 and i == j
        left = np.arange(len(ids)) if alone else np.flatnonzero(side == (0 if kind == 0 else 1))
        right = left if alone else np.flatnonzero(side != (0 if kind == 0 else 1))
        out_a, out_b = [], []
        for k in left:
            apart = right[(root[right] != root[k]) & (np.minimum(n[right], n[k]) * 100 >= np.maximum(n[right], n[k]) * percent)]
            if alone:
                apart = apart[apart > k]
            bad = np.bitwise_count(bits[apart] ^ bits[k]).sum(axis=1)
            near = np.flatnonzero(bad <= differing)
            for o in apart[near[np.argsort(bad[near], kind="stable")]]:
                if root[o] != root[k] and similar(whole[o], whole[k], percent):
                    out_a.append(ids[k])
                    out_b.append(ids[o])
                    root[root == root[o]] = root[k]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.groupBy("kind", "key", "_i", "_j").applyInArrow(compare, "a long, b long").distinct()


def told_members(signed: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """signed with ``component_id``: the least id of the component that a row's node belongs to, or the row's own id without a node."""
    reps = nodes.select("node", "rep", "many")
    linked = stored(gathered(found.join(reps, "node")), "linked")
    least = settled(gathered(linked.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("_n"))))
    some = joined(linked.select("node", "component"), least, "component", "_n", linked.count()).select("node", "least")
    per = reps.join(some, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"), "many")
    copied = stored(gathered(per), "told")
    narrow = signed.select("id", "n_shingles", "node")
    told = joined(narrow.filter("node is not null"), copied, "node", "many", narrow.count()).select("id", "n_shingles", "component_id")
    return told.unionByName(narrow.filter("node is null").select("id", "n_shingles", F.col("id").alias("component_id")))


def cluster(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, print_bits: int = 64) -> DataFrame:
    """One row a row of docs: id, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and ``kept``.

    print_bits: how many bits of a set's print name it at first; fewer only make more names to tell apart.
    """
    differing = most_differing(percent / 100)
    named = docs.select(F.col(id_col), F.col(text).alias("_text")).withColumnRenamed(id_col, "_id")
    nameless, own = named.filter("_id is null"), named.filter("_id is not null")
    signed, nodes = told_apart(stored(signatures(own, "_id", "_text", width, print_bits), "signatures"))

    rows = signed.filter("bands is not null").select(F.explode("bands").alias("key"), "node")
    buckets = rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("_z"), F.count(F.lit(1)).alias("size")).filter("a <> _z").drop("_z")
    buckets = stored(gathered(buckets.withColumn("many", F.col("size"))), "buckets")
    # Copies that several tasks have met meet again here.
    shared = stored(gathered(joined(rows, buckets, "key", "many", BANDS * signed.count()).distinct()), "shared")
    asked = shared.select("node").distinct()
    marks = signed.filter("sketch is not null").select("node", "n_shingles", "sketch").join(asked.hint("shuffle_hash"), "node", "left_semi")
    marks = stored(gathered(marks.dropDuplicates(["node"])), "marks")

    # As many blocks as the largest bucket needs that a pair is in, in powers of two so that few numbers of blocks occur.
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_most") / BLOCK)))).cast("long")
    pairs = shared.filter("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.max("size").alias("_most")).select("a", "b", parts.alias("parts"))
    near = settled(gathered(beside_leaders(pairs, marks, close_sketches(percent, differing))))
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    links = settled(gathered(beside_leaders(near, full_sets(wanted, nodes, own, "_id", "_text", width), alike(percent)).select("a", "b").distinct()))
    # Rows with the same id are one document, whatever their texts.
    texts = signed.filter("node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("_z")).filter("a <> _z").select("id", "a")
    if not texts.isEmpty():
        same = signed.filter("node is not null").select("id", F.col("node").alias("b")).join(texts, "id").filter("a <> b").select("a", "b").distinct()
        links = links.unionByName(settled(gathered(same)))
    found = components(links)

    groups = open_groups(shared.select("key", F.col("node").alias("id"), "size"), found)
    groups = stored(gathered(groups.join(marks.select(F.col("node").alias("id"), (8 * F.col("n_shingles")).alias("bytes")), "id")), "groups")
    if not groups.isEmpty():
        sets = full_sets(groups.select(F.col("id").alias("node")).distinct(), nodes, own, "_id", "_text", width)
        links = links.unionByName(settled(gathered(group_links(groups, marks, sets, percent, differing))))
        found = components(links)
    told = told_members(signed, nodes, found).select("id", "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    kind = docs.schema[id_col].dataType
    lone = signatures(nameless, "_id", "_text", width).select("id", "n_shingles", F.lit(None).cast(kind).alias("component_id"), F.lit(True).alias("kept"))
    return told.unionByName(lone).withColumnRenamed("id", id_col)
