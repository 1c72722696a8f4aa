import io
import wave

import numpy as np
import pytest

from gridloom.llm import chroma, hnsw, queries


def brute(rows, least=0.9):
    good = [(i, np.asarray(v, np.float64)) for i, v in rows if v is not None and None not in v and len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    n, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v) in enumerate(good):
        for j, w in good[k + 1 :]:
            if len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in n}


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.links(df, **more).collect()}


def test_equals_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 16))
    rows = [(int(k), (centres[k % 30] + r.normal(size=16) * 0.15 * (k % 4)).astype(np.float32).tolist()) for k in range(600)]
    rows += [(1000 + k, centres[0].astype(np.float32).tolist()) for k in range(50)] + [(2000, (2 * centres[0].astype(np.float32)).tolist())]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [float("inf")] + [0.0] * 15), (3004, [None] + [1.0] * 15), (3005, []), (3006, [1.0, 2.0]), (3007, [2.0, 4.0])]
    assert result(spark, rows, shards=3) == brute(rows)


def test_small_and_empty_tables(spark):
    assert result(spark, [(5, [1.0, 0.0])]) == {5: (0, 5)}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, id long")
    assert hnsw.links(df).count() == 0


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, hnsw.links(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_links_that_no_beam_finds(spark, monkeypatch):
    class Blind(hnsw.Graph):
        def within(self, queries, least, width):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)

    monkeypatch.setattr(hnsw, "Graph", Blind)
    r = np.random.default_rng(5)
    v = r.normal(size=(100, 32))
    rows = list(enumerate([x.tolist() for x in np.concatenate([v, v + r.normal(size=v.shape) * 0.15])]))
    assert result(spark, rows, shards=2, widenings=1) == brute(rows)


def test_recall_of_a_graph():
    r = np.random.default_rng(3)
    base = r.normal(size=(1500, 24))
    points = hnsw.unit(np.concatenate([base, base + r.normal(size=base.shape) * 0.2]))
    graph = hnsw.build(points, r.random(len(points)))
    want = points @ points.T >= 0.9
    q, p = graph.within(points, 0.9, 32)
    assert want[q, p].all() and want[q, p].sum() / want.sum() > 0.99


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    got = queries.op1_hnsw_shards(spark, "/root/testdata/sf0.001").collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute(rows)


def test_fingerprints_of_what_is_no_sound():
    assert all(len(chroma.fingerprint(x)) == 0 for x in (None, b"", b"RIFF....", b"text", chroma.melody([0.1] * 64, 0.2)))


def test_alignment_of_a_cut():
    r = np.random.default_rng(1)
    sound = chroma.melody(r.normal(size=64).tolist())
    whole = chroma.fingerprint(sound)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(chroma.RATE)
        mono = ((np.frombuffer(sound[44:], np.uint8)[20 * chroma.HOP :].astype(np.int16) - 128) * 250).astype("<i2")
        w.writeframes(np.repeat(mono, 2).tobytes())
    cut = chroma.fingerprint(out.getvalue())
    offset, wrong, common = chroma.matches(whole, cut, 0.15)
    assert offset == 20 and wrong < 0.02 and common == len(cut)
    assert chroma.matches(whole, chroma.fingerprint(chroma.melody(r.normal(size=64).tolist())), 0.15) is None


def test_groups_of_recordings(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(8, 64))
    rows = [(k, v[k % 8].tolist()) for k in range(24)] + [(100 + k, (v[k] + r.normal(size=64) * 0.01).tolist()) for k in range(8)] + [(200, None), (201, [0.0] * 64), (202, [0.0] * 64)]
    media = chroma.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {x["rec_id"]: x["group_id"] for x in chroma.group(media).collect()}
    assert got == {k: k % 8 for k in range(24)} | {100 + k: k for k in range(8)} | {200: 200, 201: 201, 202: 201}
    assert chroma.group(media.limit(0)).count() == 0


def test_groups_equal_brute_force(spark):
    rows = queries.table(spark, "/root/testdata/sf0.001", "embeddings").collect()
    prints = {r["vec_id"]: chroma.fingerprint(chroma.melody(r["embedding"])) for r in rows}
    root = {i: i for i in prints}
    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if root[a] != root[b] and chroma.linked(prints[a], prints[b], 0.15):
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    got = queries.op8_chroma_fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert {r["vec_id"] if "vec_id" in r else r["rec_id"]: r["group_id"] for r in got} == root
    assert all(r["n_frames"] == len(prints[r["rec_id"]]) for r in got)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sample_widths(width):
    x = np.sin(np.arange(400) / 9)
    whole = (x * (2 ** (8 * width - 1) - 1)).astype(np.int64)
    raw = (whole + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in whole)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(chroma.RATE)
        w.writeframes(raw)
    assert np.allclose(chroma.samples(out.getvalue()), x, atol=2 ** (2 - 8 * width))


def noisy(prints, share, seed):
    """Each print's copy with that share of its bits flipped."""
    r = np.random.default_rng(seed)
    return [f ^ (r.random((len(f), 32)) < share).dot(1 << np.arange(32, dtype=np.uint64)).astype(np.uint32) for f in prints]


def test_all_matches_share_an_integer():
    r = np.random.default_rng(6)
    prints = [chroma.fingerprint(chroma.melody(r.normal(size=64).tolist())) for _ in range(40)]
    every = prints + noisy(prints, 0.08, 1) + noisy(prints, 0.13, 2)
    want = {(a, b) for a in range(len(every)) for b in range(a + 1, len(every)) if chroma.linked(every[a], every[b], 0.15)}
    keys = [chroma.integers(f) for f in every]
    got = set()
    for key in np.unique(np.concatenate(keys)):
        rows = np.array([k for k, x in enumerate(keys) if key in x])
        got |= {tuple(sorted(p)) for p in chroma.agreeing(every, int(key), rows, None, 0.15)}
        half = len(rows) // 2
        assert set(chroma.agreeing(every, int(key), rows[:half], rows[half:], 0.15)) <= set(chroma.agreeing(every, int(key), rows, None, 0.15))
    assert want <= got and len(want) >= 30
    assert any(not len(np.intersect1d(chroma.keys(every[a]), chroma.keys(every[b]))) for a, b in want)


def test_noisy_copies_group_as_by_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(6)
    prints = [chroma.fingerprint(chroma.melody(r.normal(size=64).tolist())) for _ in range(30)]
    every = prints + noisy(prints, 0.1, 3)
    made = spark.createDataFrame([(k, f.tobytes(), chroma.keys(f).tolist(), f.tobytes().hex()) for k, f in enumerate(every)], "id long, print binary, keys array<long>, mark string")
    monkeypatch.setattr(chroma, "fingerprints", lambda *_: made)
    root = list(range(len(every)))
    for a in range(len(every)):
        for b in range(a + 1, len(every)):
            if chroma.linked(every[a], every[b], 0.15):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    got = {x["rec_id"]: x["group_id"] for x in chroma.group(made, audio="print").collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(root) - 5


def header(audio, at, value, size):
    return audio[:at] + int(value).to_bytes(size, "little") + audio[at + size :]


def test_odd_headers_have_no_fingerprint():
    sound = chroma.melody(np.random.default_rng(1).normal(size=64).tolist())
    assert len(chroma.fingerprint(sound))
    for bits in (0, 1, 7, 33, 40, 64, 65535):
        chroma.fingerprint(header(sound, 34, bits, 2))
    assert not len(chroma.fingerprint(header(sound, 34, 64, 2))) and not len(chroma.fingerprint(header(sound, 34, 40, 2)))
    for rate in (0, 1, 100, chroma.SLOWEST - 1):
        assert not len(chroma.fingerprint(header(sound, 24, rate, 4)))
    for channels in (0, 3, 65535):
        chroma.fingerprint(header(sound, 22, channels, 2))
    assert not len(chroma.fingerprint(header(sound, 24, 2**32 - 1, 4)))
    r = np.random.default_rng(2)
    for _ in range(300):
        broken = bytearray(sound[: r.integers(0, 400)])
        for at in r.integers(0, max(1, min(44, len(broken))), 6):
            if len(broken):
                broken[at] = r.integers(0, 256)
        chroma.fingerprint(bytes(broken))


def test_recordings_with_ids_of_text_null_and_repeated_ids(spark):
    r = np.random.default_rng(8)
    one, two, three = (chroma.melody(r.normal(size=64).tolist()) for _ in range(3))
    slow = header(one, 24, 10, 4)
    rows = [("b", one, 7), ("ax", one, 7), (None, one, 7), ("c", two, 7), ("d", None, 7), ("e", b"no sound", 7), ("f", slow, 7), ("g", two, 7), ("g", three, 7), ("h", three, 7), (None, None, 7)]
    media = spark.createDataFrame(rows, "rec_id string, audio binary, node int").repartition(3)
    got = sorted(((x["rec_id"] or "", x["n_frames"] > 0, x["group_id"] or "", x["offset"]) for x in chroma.group(media).collect()), key=str)
    # g is one recording with the sound of c and of h.
    want = [("", False, "", None), ("", True, "", None), ("ax", True, "ax", 0), ("b", True, "ax", 0), ("c", True, "c", 0), ("d", False, "d", None), ("e", False, "e", None), ("f", False, "f", None), ("g", True, "c", 0), ("g", True, "c", None), ("h", True, "c", None)]
    assert got == sorted(want, key=str)


def test_parts_are_bounded_in_bytes(spark, monkeypatch):
    """However small the parts and blocks are, the groups are those of all pairs."""
    r = np.random.default_rng(6)
    prints = [chroma.fingerprint(chroma.melody(r.normal(size=64).tolist())) for _ in range(12)]
    every = prints + noisy(prints, 0.1, 3) + noisy(prints, 0.1, 4)
    made = spark.createDataFrame([(k, f.tobytes(), chroma.keys(f).tolist(), f.tobytes().hex()) for k, f in enumerate(every)], "id long, print binary, keys array<long>, mark string")
    monkeypatch.setattr(chroma, "fingerprints", lambda *_: made)
    for name, value in (("BLOCK", 3), ("BLOCK_BYTES", 700), ("PART_BYTES", 20_000)):
        monkeypatch.setattr(chroma, name, value)
    root = list(range(len(every)))
    for a in range(len(every)):
        for b in range(a + 1, len(every)):
            if chroma.linked(every[a], every[b], 0.15):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert {x["rec_id"]: x["group_id"] for x in chroma.group(made, audio="print").collect()} == dict(enumerate(root))


def test_vector_ids_of_text_and_nulls(spark):
    rows = [("b", [1.0, 0.0]), ("ax", [1.0, 0.01]), (None, [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in hnsw.links(df).collect())
    assert got == [("None", 0, "None", True), ("ax", 1, "ax", True), ("b", 1, "ax", False), ("c", 0, "c", True), ("d", 0, "d", True)]


def test_wide_vectors_give_more_shards(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 32))
    rows = [(k, (v[k % 60] + r.normal(size=32) * 0.02).tolist()) for k in range(180)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few = sorted(map(tuple, hnsw.links(df).select("vec_id", "n_links", "component_id", "kept").collect()))
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 4096)
    assert sorted(map(tuple, hnsw.links(df).select("vec_id", "n_links", "component_id", "kept").collect())) == few
    assert any(n for _, n, _, _ in few)


def test_each_two_shards_have_a_task(spark):
    """Numbers of all pairs of six shards fall into a partition each."""
    from pyspark.sql import functions as F

    pairs = spark.range(6).select(F.col("id").alias("_i")).crossJoin(spark.range(6).select(F.col("id").alias("_j"))).filter("_i <= _j")
    pairs = pairs.withColumn("_pair", (F.col("_i") * 6 - F.expr("_i * (_i - 1) div 2") + F.col("_j") - F.col("_i")).cast("int")).repartition(5)
    sizes = hnsw.dealt(pairs, 6).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 21 and all(r["count"] == 1 for r in sizes)
