"""Chroma fingerprints of audio columns, and recordings aligned by them.

A recording is decoded, mixed to one channel and resampled; spectra of its
overlapping frames are folded into twelve pitch classes, smoothed over time and
normalised. On the integral image of that picture, rectangle filters compare
neighbouring stretches of time and pitch; each filter's value gives two bits,
and all filters at a place one 32-bit integer. Two recordings are aligned at the
offset at which most of their integers agree (run starts alone vote, so held
notes and silence don't multiply), and matched by the share of differing bits.

Recordings with equal fingerprints are one node from the start. Those that share a pair
of neighbouring integers are first compared with their bucket's leader. Then all
that share one integer at run starts and are still in different groups are
compared inside tasks. An alignment needs such an integer at its own offset, so
none is missed: first the bits at that offset are counted, then the two aligned,
the smaller print first.

Cases: null bytes, what is no PCM WAV (whatever its header says), sound slower than
``SLOWEST`` samples a second or shorter than a filter has no fingerprint and matches
nothing, and its group is its own id; so is that of a recording without an id. Ids may be
of any type with an order. Rows with the same id are one recording and in one group, each
with its own length. Very long recordings are read whole, in one task each, and compared
in blocks of bounded bytes. Other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, joined, ready, settled, stored
from .graph import components
from .neardup import BLOCK, BLOCK_BYTES, beside_leaders, in_blocks, open_groups

RATE, FRAME, HOP = 4000, 2048, 256
LOWEST, HIGHEST = 55.0, 1760.0
#: Samples a second that a recording has at least, so resampling multiplies its samples by four at most.
SLOWEST = 1000
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
STEPS = (-0.08, 0.0, 0.08)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: (kind, first pitch class, pitch classes, frames): sixteen rectangles by rule, of growing length.
FILTERS = [(("time", "pitch", "both", "middle")[k % 4], (5 * k) % 9, 3 + k % 2, 6 + 2 * (k % 6)) for k in range(16)]
LONGEST = max(w for *_, w in FILTERS)


def samples(audio: bytes | None) -> np.ndarray | None:
    """A PCM WAV's sound as numbers from -1 to 1 at ``RATE``, channels averaged; None for what isn't one."""
    if not audio:
        return None
    try:
        with wave.open(io.BytesIO(audio)) as w:
            channels, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, ValueError, OverflowError, RuntimeError, struct.error):
        return None
    # A header may say anything; below SLOWEST a few bytes would stand for hours of sound.
    if width not in (1, 2, 3, 4) or channels < 1 or rate < SLOWEST:
        return None
    if width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8, len(raw) // 3 * 3).reshape(-1, 3)
        x = wide.reshape(-1).view("<i4").astype(np.float64) / 2**31
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width], len(raw) // width).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


def _classes() -> np.ndarray:
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hertz), 12))
    used = np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST))
    fold[used, np.round(12 * np.log2(hertz[used] / 440)).astype(int) % 12] = 1
    return fold


FOLD, HANN = _classes(), np.hanning(FRAME)


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames by pitch classes, smoothed and of norm 1, or 0 where there is no sound."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    out = []
    starts = np.arange(0, len(x) - FRAME + 1, HOP)
    for at in range(0, len(starts), 512):
        frames = x[starts[at : at + 512, None] + np.arange(FRAME)] * HANN
        out.append((np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ FOLD)
    picture = np.concatenate(out)
    picture = np.stack([np.convolve(picture[:, k], SMOOTH, "same") for k in range(12)], axis=1)
    norm = np.linalg.norm(picture, axis=1, keepdims=True)
    return np.where(norm > 1e-9, picture / np.maximum(norm, 1e-9), 0)


def fingerprint(audio: bytes | None) -> np.ndarray:
    """The recording's packed integers, one a frame but for the last filter's length."""
    x = samples(audio)
    picture = chroma(x) if x is not None else np.zeros((0, 12))
    n = len(picture) - LONGEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(picture) + 1, 13))
    whole[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)
    area = lambda t, w, y, h: whole[at + t + w, y + h] - whole[at + t, y + h] - whole[at + t + w, y] + whole[at + t, y]
    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(FILTERS):
        half, mid = w // 2, h // 2
        if kind == "time":
            a, b = area(0, half, y, h), area(half, half, y, h)
        elif kind == "pitch":
            a, b = area(0, w, y, mid), area(0, w, y + mid, h - mid)
        elif kind == "both":
            a, b = area(0, half, y, mid) + area(half, half, y + mid, h - mid), area(half, half, y, mid) + area(0, half, y + mid, h - mid)
        else:
            third = w // 3
            a, b = area(third, third, y, h), area(0, third, y, h) + area(2 * third, third, y, h)
            b = b / 2
        level = np.searchsorted(STEPS, np.log((1 + a) / (1 + b)), side="right")
        out |= GRAY[level] << np.uint32(2 * k)
    return out


def runs(f: np.ndarray) -> np.ndarray:
    """Where a run of equal integers begins."""
    return np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)


def keys(f: np.ndarray) -> np.ndarray:
    """The distinct pairs of neighbouring integers at run starts, as hashes."""
    at = runs(f)
    later = f[np.minimum(at + 1, len(f) - 1)].astype(np.uint64) if len(f) else np.zeros(0, np.uint64)
    mixed = (f[at].astype(np.uint64) << np.uint64(32)) | later
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(int(m).to_bytes(8, "little")) for m in mixed), np.uint64, len(mixed))).view(np.int64)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float, int] | None:
    """(offset of b's beginning in a, share of differing bits, frames in common) at the offset with the most votes; ties take the smallest."""
    ra, rb = runs(a), runs(b)
    order = np.argsort(b[rb], kind="stable")
    held = b[rb][order]
    lo, hi = np.searchsorted(held, a[ra], "left"), np.searchsorted(held, a[ra], "right")
    count = hi - lo
    if not count.sum():
        return None
    place = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    offsets, votes = np.unique(np.repeat(ra, count) - rb[order][place], return_counts=True)
    offset = int(offsets[votes.argmax()])
    x, y = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
    common = min(len(x), len(y))
    return offset, float(np.bitwise_count(x[:common] ^ y[:common]).sum()) / (32 * common), common


def matches(a: np.ndarray, b: np.ndarray, most: float) -> tuple[int, float, int] | None:
    """The alignment, if at least half of the shorter recording is in common and few bits differ."""
    found = align(a, b)
    return found if found and found[1] <= most and 2 * found[2] >= min(len(a), len(b)) else None


def linked(a: np.ndarray, b: np.ndarray, most: float) -> bool:
    """Whether two recordings match, the smaller print first, so that the answer doesn't depend on their order."""
    first, second = sorted((a, b), key=lambda f: f.tobytes())
    return matches(first, second, most) is not None


def integers(f: np.ndarray) -> np.ndarray:
    """The distinct integers at run starts, without which nothing aligns."""
    return np.unique(f[runs(f)]).astype(np.int64)


def agreeing(prints: list[np.ndarray], key: int, left: np.ndarray, right: np.ndarray | None, most: float) -> list[tuple[int, int]]:
    """Pairs of ``left`` with ``right``, or inside ``left``, that differ in few enough bits where both have the integer ``key`` at a run start."""

    def found(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = [np.flatnonzero((f == key) & np.concatenate([[True], f[1:] != f[:-1]])) for f in (prints[r] for r in rows)]
        return np.repeat(rows, [len(x) for x in at]), np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)

    (who, place), out = found(left), set()
    others, where = found(right) if right is not None else (who, place)
    size = np.array([len(prints[r]) for r in others], np.int64)
    rest = size - where
    step = max(1, (1 << 21) // int(size.max(initial=1)))
    for at in range(0, len(others), step):
        part = slice(at, at + step)
        before, after = int(where[part].max()), int(rest[part].max())
        held, there = np.zeros((len(others[part]), before + after), np.uint32), np.zeros((len(others[part]), before + after), bool)
        for k, (r, p) in enumerate(zip(others[part], where[part], strict=True)):
            held[k, before - p : before - p + len(prints[r])] = prints[r]
            there[k, before - p : before - p + len(prints[r])] = True
        for k, (r, p) in enumerate(zip(who, place, strict=True)):
            first = 0 if right is not None else max(0, k + 1 - at)
            if first >= len(held):
                continue
            one, low = prints[r][max(0, p - before) : p + after], max(0, before - p)
            common = np.minimum(where[part][first:], p) + np.minimum(rest[part][first:], len(prints[r]) - p)
            wrong = (np.bitwise_count(held[first:, low : low + len(one)] ^ one) * there[first:, low : low + len(one)]).sum(axis=1, dtype=np.int64)
            good = (wrong / (32 * common) <= most) & (2 * common >= np.minimum(size[part][first:], len(prints[r])))
            out.update((int(r), int(o)) for o in others[part][first:][good] if o != r)
    return sorted(out)


def agreeing_any(prints: list[np.ndarray], left: np.ndarray, right: np.ndarray, most: float) -> list[tuple[int, int]]:
    """As ``agreeing``, by each integer that both sides have."""
    if len(left) > len(right):
        left, right = right, left

    def placed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = [integers(prints[r]) for r in rows]
        keys, who = np.concatenate([*held, np.zeros(0, np.int64)]), np.repeat(rows, [len(x) for x in held])
        order = np.argsort(keys, kind="stable")
        return keys[order], who[order]

    (lk, lr), (rk, rr), out = placed(left), placed(right), set()
    for key in np.intersect1d(lk, rk):
        of = lambda keys, who: who[np.searchsorted(keys, key, "left") : np.searchsorted(keys, key, "right")]  # noqa: B023, E731
        out.update(agreeing(prints, int(key), of(lk, lr), of(rk, rr), most))
    return sorted(out)


def fingerprints(media: DataFrame, id_col: str, audio: str) -> DataFrame:
    """(id, print, keys, mark): packed integers, candidate keys, and a 128-bit name of the print, null without a fingerprint."""
    ready(media.sparkSession)
    schema = T.StructType([
        T.StructField("id", media.schema[id_col].dataType), T.StructField("print", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("mark", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py()) for x in batch.column(1)]
            packed = [f.tobytes() for f in made]
            marks = [xxhash.xxh3_128_hexdigest(p) if p else None for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array([keys(f) for f in made], pa.list_(pa.int64())), pa.array(marks, pa.string())], names=schema.names)

    return media.select(id_col, audio).mapInArrow(run, schema)


def opened(print_: bytes) -> np.ndarray:
    return np.frombuffer(print_, np.uint32)


def star_links(heads: DataFrame, most: float) -> DataFrame:
    """Links (a, b) of nodes with a leader of a bucket of neighbouring integers: the member that meets most others.

    A leader's pairs are dealt into blocks, and a task has its print and one batch in memory.
    """
    rows = heads.select(F.explode("keys").alias("key"), F.col("node").alias("id")).distinct()
    sizes = settled(gathered(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("many", F.col("size"))))
    shared = stored(gathered(joined(rows, sizes, "key", "many", rows.count())), "shared")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("id").alias("a"))).alias("top")
    leaders = settled(gathered(shared.join(weight, "id").groupBy("key").agg(best, F.count(F.lit(1)).alias("many")).select("key", "top.a", "many")))
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_most") / BLOCK)))).cast("long")
    stars = joined(shared, leaders, "key", "many", shared.count()).filter("a <> id")
    pairs = stars.groupBy("a", F.col("id").alias("b")).agg(F.max("size").alias("_most")).select("a", "b", parts.alias("parts"))
    near = lambda x, y: linked(opened(x[0]), opened(y[0]), most)
    return settled(gathered(beside_leaders(pairs, heads.select("node", "print"), near).select("a", "b").distinct()))


def meeting_links(heads: DataFrame, found: DataFrame, most: float) -> DataFrame:
    """Links (a, b) that join components which share one integer at run starts; blocks of them are compared in parts of ``PART_BYTES``."""
    prints = heads.select(F.col("node").alias("id"), "print")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [integers(opened(x.as_buffer())) for x in batch.column(1)]
            own = batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*held, np.zeros(0, np.int64)])), own], names=["key", "id"])

    single = stored(prints.mapInArrow(exploded, "key long, id long"), "integers")
    often = single.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("many", F.col("size"))
    meeting = open_groups(joined(single, settled(gathered(often)), "key", "many", single.count()), found, 2)
    lengths = prints.select("id", F.octet_length("print").alias("bytes"))
    meeting = stored(gathered(meeting.join(lengths, "id")), "meeting")

    def compare(groups: pa.Table, texts: pa.Table) -> pa.Table:
        ids, whole = texts.column("_id").to_pylist(), [opened(x.as_buffer()) for x in texts.column("print")]
        at = {i: k for k, i in enumerate(ids)}
        table = groups.sort_by([(c, "ascending") for c in ("kind", "key", "_i", "_j")])
        member = np.array([at[i] for i in table.column("id").to_pylist()], np.int64)
        sides = table.column("side").to_numpy()
        label = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        root = np.zeros(len(ids), np.int64)
        root[member] = label
        named = [table.column(c).to_pylist() for c in ("kind", "key", "_i", "_j")]
        edges = [k for k in range(len(member)) if k == 0 or any(c[k] != c[k - 1] for c in named)] + [len(member)]
        out: tuple[list, list] = ([], [])
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rows, side = member[low:high], sides[low:high]
            alone = named[0][low] == 0
            inner = alone and named[2][low] == named[3][low]
            left, right = (rows, None) if inner else (rows[side == 0], rows[side == 1])
            for k, o in agreeing(whole, named[1][low], left, right, most) if alone else agreeing_any(whole, left, right, most):
                if root[k] != root[o] and linked(whole[k], whole[o], most):
                    out[0].append(ids[k])
                    out[1].append(ids[o])
                    root[root == root[o]] = root[k]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    placed = stored(in_blocks(meeting, BLOCK, BLOCK_BYTES), "blocks")
    held = placed.join(lengths, "id").agg(F.sum("bytes")).first()[0]
    if not held:
        return meeting.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    # A recording's integers go to each part only once; a part has so many bytes at most, but for its last blocks.
    parts = max(heads.sparkSession.sparkContext.defaultParallelism, held // PART_BYTES + 1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("kind", "key", "_i", "_j"), F.lit(parts)).cast("int"))
    texts = placed.select(F.col("part").alias("_part"), F.col("id").alias("_id")).distinct().join(prints.withColumnRenamed("id", "_id"), "_id")
    return settled(gathered(placed.groupBy("part").cogroup(texts.groupBy("_part")).applyInArrow(compare, "a long, b long").distinct()))


#: Bytes of prints that a task compares, at most, but for its last blocks.
PART_BYTES = 64 << 20


def told_nodes(nodes: DataFrame, heads: DataFrame, found: DataFrame, most: float) -> DataFrame:
    """(node, many, n_frames, group_id, offset, bit_error): each node aligned with the head of its group.

    A group's nodes are dealt into blocks, and its head's print goes to each block.
    """
    own = stored(gathered(nodes.select("node", "rep", "many").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))), "own")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts")
    groups = own.groupBy("component").agg(F.min("rep").alias("group_id"), F.min_by("node", "rep").alias("lead"), F.count(F.lit(1)).alias("_n"), blocks)
    groups = stored(gathered(groups), "groups")
    asked = joined(own.select("node", "many", "component"), groups, "component", "_n", own.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    leads = groups.select(F.col("lead").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    leads = leads.join(heads.select("node", "print"), "node").select(F.col("node").alias("lead"), "block", F.col("print").alias("_lead"))
    beside = asked.join(heads.select("node", "print"), "node").join(leads, ["lead", "block"]).select("node", "many", "group_id", "print", "_lead")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_, lead = ([opened(x.as_buffer()) for x in batch.column(k)] for k in (3, 4))
            seen = [matches(y, x, most) for x, y in zip(own_, lead, strict=True)]
            made = [pa.array([len(x) for x in own_], pa.int32()), pa.array([s and s[0] for s in seen], pa.int32()), pa.array([s and s[1] for s in seen], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made[0], batch.column(2), *made[1:]], names=out.names)

    out = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("many", T.LongType()), T.StructField("n_frames", T.IntegerType()), T.StructField("group_id", nodes.schema["rep"].dataType),
        T.StructField("offset", T.IntegerType()), T.StructField("bit_error", T.DoubleType()),
    ])
    return stored(gathered(beside.mapInArrow(place, out)), "told")


def group(media: DataFrame, *, id_col: str = "rec_id", audio: str = "audio", most: float = 0.15) -> DataFrame:
    """One row a recording: id, ``n_frames``, ``group_id`` (the smallest id reached by matches), and the ``offset`` in frames
    and ``bit_error`` of its alignment with that recording, null where the two don't align by themselves."""
    made = stored(fingerprints(media, id_col, audio), "prints")
    sound = made.filter("mark is not null and id is not null")
    copies = sound.groupBy("mark").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"))
    nodes = stored(gathered(copies).withColumn("node", F.monotonically_increasing_id()), "nodes")
    # A print's first recording is found by its id, which few rows share, and not by its mark, which many may.
    own = sound.join(nodes.select(F.col("rep").alias("id"), "mark", "node"), ["id", "mark"])
    heads = stored(own.select("node", "print", "keys").dropDuplicates(["node"]), "heads")
    total = sound.count()
    members = stored(gathered(joined(sound.select("id", "mark"), nodes.select("mark", "node", "many"), "mark", "many", total).select("id", "node")), "members")

    links = star_links(heads, most)
    # Rows with the same id are one recording, whatever their sound.
    several = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("_z")).filter("a <> _z").select("id", "a")
    if not several.isEmpty():
        same = members.select("id", F.col("node").alias("b")).join(several, "id").filter("a <> b").select("a", "b").distinct()
        links = links.unionByName(settled(gathered(same)))
    links = links.unionByName(meeting_links(heads, components(links), most))
    told = told_nodes(nodes, heads, components(links), most)
    placed = joined(members, told, "node", "many", total).select("id", "n_frames", "group_id", "offset", "bit_error")
    silent = made.filter("mark is null or id is null").select("id", (F.octet_length("print") / 4).cast("int").alias("n_frames"), F.col("id").alias("group_id"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("double").alias("bit_error"))
    return placed.unionByName(silent).withColumnRenamed("id", id_col)


def melody(vector: list[float] | None, seconds: float = 6.4, rate: int = RATE) -> bytes | None:
    """A WAV whose notes follow a vector's components: a deterministic stand-in for recordings."""
    if vector is None or any(v is None or not np.isfinite(v) for v in vector) or len(vector) < 2:
        return None
    v = np.asarray(vector, np.float64)
    v = v / max(1e-9, np.abs(v).max())
    low, high = 165 * 2 ** v[0::2][: len(v) // 2], 440 * 2 ** v[1::2][: len(v) // 2]
    n = int(seconds * rate / len(low))
    cycles = lambda hertz: np.cumsum(np.repeat(hertz, n)) / rate
    sound = np.sin(2 * np.pi * cycles(low)) + np.sin(2 * np.pi * cycles(high))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes((sound * 60 + 128).astype(np.uint8).tobytes())
    return out.getvalue()


def recordings(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(rec_id, audio): each vector as a melody."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 128) for k in range(0, whole.num_rows, 128)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([melody(v.as_py()) for v in batch.column(1)], pa.binary())], names=["rec_id", "audio"])

    return rows.select(id_col, vector).mapInArrow(run, T.StructType([T.StructField("rec_id", rows.schema[id_col].dataType), T.StructField("audio", T.BinaryType())]))
