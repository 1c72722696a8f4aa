import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, graph, neardup, queries


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, width, percent=80):
    """(set size, smallest reachable id) of each document, all pairs compared."""
    sets = {}
    for i, text in docs:
        w = words_of(text)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else (frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(spark, docs, width):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.cluster(df, width=width).collect()}


def family(seed, size, words=60, edits=4):
    """Near copies of one text, each with a few words changed."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("width", "block"), [(2, neardup.BLOCK), (5, neardup.BLOCK), (2, 5)])
def test_equals_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(7)
    texts = family(1, 40) + family(2, 60, 40, 6) + family(4, 60, 30, 5) + family(3, 3) * 5 + [" ".join(r.choice("abcdef") for _ in range(r.randrange(12))) for _ in range(60)]
    texts += [None, "", " \t\n", "One", "one", "ONE two", "É é", "x\x1cy", "A B C D E F " * 3000]
    r.shuffle(texts)
    docs = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    assert result(spark, docs, width) == brute(docs, width)


def test_a_group_that_meets_only_through_others(spark):
    """Two families chained by copies in between, with more members than a bucket's leader links."""
    base = [f"w{k}" for k in range(100)]
    docs = [(k, " ".join([*(f"n{j}" for j in range(k)), *base[k:]])) for k in range(0, 40, 4)]
    assert result(spark, docs, 2) == brute(docs, 2)


@pytest.mark.parametrize("bits", [64, 3])
def test_ids_of_any_type_nulls_and_prints_that_clash(spark, bits):
    texts = family(5, 12) + family(6, 5) * 3 + ["one", "two", "", None]
    docs = [(f"{k:03d}", t) for k, t in enumerate(texts)]
    want = brute(docs, 2)
    more = [(None, texts[0]), (None, texts[0]), (None, None)]
    df = spark.createDataFrame([*docs, *more], "doc_id string, text string")
    got = neardup.cluster(df, width=2, print_bits=bits).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 3 and len(got) == len(texts) + 3


def test_one_id_with_several_texts_is_one_document(spark):
    texts = family(8, 6, edits=1)
    docs = [(1, texts[0]), (2, "some other words"), (2, texts[1]), (2, texts[1]), (3, "some other words"), (4, "alone")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.cluster(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect()}
    whole = len(set(zip(texts[0].split(), texts[0].split()[1:], strict=False))), len(set(zip(texts[1].split(), texts[1].split()[1:], strict=False)))
    assert got == {(1, whole[0], 1, True), (2, 2, 1, False), (2, whole[1], 1, False), (3, 2, 1, False), (4, 1, 4, True)}


def test_heavy_keys_are_not_dealt(spark):
    left = spark.range(4000).selectExpr("if(id < 3000, 7, id) k", "id")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.col("k") * 2)
    got = common.joined(left, right, "k", "n", 4000)
    assert got.columns == ["k", "id", "v"] and got.count() == 4000 and got.filter("v <> 2 * k").isEmpty()


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, id long, key string")
    assert {r["component_id"] for r in neardup.cluster(df).collect()} == {1}
    assert neardup.cluster(df.limit(0)).count() == 0


def test_odd_sketch_tells_similarity():
    r = np.random.default_rng(1)
    for similarity in (0.7, 0.8, 0.95):
        n, apart = 2000, []
        common = round(2 * n * similarity / (1 + similarity))
        for _ in range(20):
            x = r.integers(0, 1 << 63, 2 * n - common, np.uint64)
            a, b = (neardup.odd_sketch(neardup.samples(s)) for s in (x[:n], np.concatenate([x[:common], x[n:]])))
            apart.append(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
        estimate = 1 + neardup.SKETCH_BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * np.mean(apart) / neardup.SKETCH_BITS)
        assert estimate == pytest.approx(similarity, abs=0.02)
        assert max(apart) <= neardup.most_differing(similarity)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = queries.op7_odd_sketches(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len(got) == len(docs) and max(Counter(r["doc_id"] for r in got).values()) == 1
