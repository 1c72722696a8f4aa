import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def words(r, letters, n):
    return " ".join("".join(r.choice(list(letters), r.integers(2, 8))) for _ in range(n))


def test_language_of_each_text(spark):
    r = np.random.default_rng(1)
    alphabets = {"aa": "abcdeé", "bb": "fghijö", "cc": "абвгд"}
    rows = [(k, words(r, alphabets[lang], 40), lang, None) for k, lang in enumerate(list(alphabets) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    filters = langid.learn(df, queries.id_remainder(4) != 2)
    assert sorted(filters.langs) == sorted(alphabets)
    odd = [(1000, None, None, None), (1001, "", None, None), (1002, "12 ?!", None, None), (1003, "ΩΩΩ", None, None), (1004, "ABCDE É", None, None), (1005, words(r, "fghij", 100_000), None, None)]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(spark.createDataFrame(rows + odd, df.schema), filters).collect()}
    assert all(got[k][0] == lang for k, _, lang, _ in rows)
    assert [got[k] for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003] == (filters.langs[0], 0.0) and got[1004][0] == "aa" and got[1005][0] == "bb" and got[1005][1] > 0.9


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    filters = langid.learn(df, queries.id_remainder(4) != 2)
    assert [tuple(x) for x in langid.predict(df.select("text"), filters).collect()] == [("abc", "und", 0.0)]
    assert langid.predict(df.limit(0).select("text"), filters).count() == 0


def test_long_texts_are_counted_whole():
    filters = langid.Filters(["x"], np.ones((4096, 1), np.uint8))
    texts = ["ab cde fghij " * n for n in (1, 30_000, 90_000)]
    total, hits = filters.counts(texts)
    one = filters.counts(["ab cde fghij "])[0][0]
    assert (hits[:, 0] == total).all() and total.tolist() == [one, one * 30_000, one * 90_000]
    points = langid.codes("ab c")
    assert len(langid.grams(points, len(points))[0]) == 9


def test_filters_are_corrected_for_false_positives():
    r = np.random.default_rng(2)
    stored = r.integers(0, 1 << 63, 4000, np.uint64)
    filters = langid.build(["x", "y"], np.repeat([0, 1], 2000), stored, np.full(4000, 50), bits=4)
    other = r.integers(0, 1 << 63, 100_000, np.uint64)
    seen = (filters.masks(other)[:, 0] & 1).mean()
    assert seen == pytest.approx(filters.false_rates()[0], abs=0.01) and seen > 0.02
    assert (filters.masks(stored[:2000])[:, 0] & 1).all() and (filters.masks(stored[2000:])[:, 0] & 2).all()


def test_more_than_64_languages():
    n = 70
    gram = np.random.default_rng(3).integers(0, 1 << 63, n * 20, np.uint64)
    filters = langid.build([f"l{k}" for k in range(n)], np.repeat(np.arange(n), 20), gram, np.full(n * 20, 5), least=0)
    found = filters.masks(gram)
    assert filters.table.shape[1] == 2 and all((found[k * 20 : k * 20 + 20, k // 64] >> np.uint64(k % 64) & np.uint64(1)).all() for k in range(n))


def test_language_query(spark):
    got = {r["doc_id"]: r for r in queries.op2_language_bitmask(spark, FOLDER).collect()}
    docs = queries.table(spark, FOLDER, "documents").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert all(got[d["doc_id"]]["held_out"] == (d in held) for d in docs) and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.98


def toxic_corpus(seed=0, n=900):
    r = np.random.default_rng(seed)
    vocabulary = [words(r, "abcdefghij", 1) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        text = list(r.choice(vocabulary, r.integers(10, 80)))
        bad = k % 8 == 0
        if bad:
            text.insert(int(r.integers(len(text))), r.choice(["zqslur", "zqinsult", "zqhate"]))
        rows.append((k, " ".join(text), "x"))
        labels.append((k, 1, int(bad), "clash"))
    return rows, labels


def test_toxicity_from_positive_and_unlabelled_texts(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(0, 1, None, "again"), (None, 1, 1, "")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.learn(docs, known, queries.id_remainder(3) != 1)
    extra = [(5000, None, ""), (5001, "", ""), (5002, "word " * 50_000 + "ZQslur", "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows + extra, docs.schema), model).collect()}
    held = [k for k in range(len(rows)) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.7) == (k % 8 == 0) for k in held]) > 0.99
    assert got[5000] == got[5001] < 0.3 and got[5002] > 0.7 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_positive_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.learn(docs, known, queries.id_remainder(3) != 7)
        assert all(r["score"] < 1e-9 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), toxicity.EMPTY).count() == 0


def test_risk_is_corrected_for_the_prior():
    """With a fifth of the unlabelled texts toxic, clean ones still score low."""
    r = np.random.default_rng(5)
    noise = lambda: r.integers(10, 60, 6)
    toxic = [np.unique(np.append(noise(), 1)).astype(np.uint32) for _ in range(200)]
    plain = [np.unique(np.append(noise(), 1) if k % 5 == 0 else noise()).astype(np.uint32) for k in range(1000)]
    model = toxicity.fit(toxic, plain, 0.2)
    assert 1 in model.features
    bad = model.bias + model.weights[model.features == 1][0]
    assert 1 / (1 + np.exp(-bad)) > 0.7 and 1 / (1 + np.exp(-model.bias)) < 0.2


def test_toxicity_query(spark):
    got = {r["doc_id"]: r for r in queries.op10_toxicity_nnpu(spark, FOLDER).collect()}
    assert len(got) == queries.table(spark, FOLDER, "documents").count()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())


def test_learning_uses_all_of_3000_toxic_texts(spark):
    rows = [(k, f"bad{k % 7} " + " ".join(f"w{k * j % 97}x" for j in range(1, 4)) if k < 3200 else " ".join(f"w{k * j % 89}x" for j in range(1, 6))) for k in range(12600)]
    letters = str.maketrans("0123456789", "abcdefghij")
    docs = spark.createDataFrame([(k, t.translate(letters)) for k, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 3200)) for k in range(0, 12600)], "doc_id long, toxic int")
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    order = [(r["doc_id"], r["text"]) for r in docs.orderBy(draw).collect()]
    want = toxicity.fit([toxicity.text_features(t) for k, t in order if k < 3200][:3000], [toxicity.text_features(t) for _, t in order][:9000], 3200 / 12600)
    got = toxicity.learn(docs, labels, F.lit(True))
    assert np.array_equal(got.features, want.features) and len(want.features)
    assert np.allclose(got.weights, want.weights) and np.isclose(got.bias, want.bias)


@pytest.mark.parametrize("total", [90_000, 110_000, 200_000])
def test_grams_met_once_stay_at_any_size(total):
    gram, n = np.arange(1, 1002, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.ones(1001, np.int64)
    n[0] = total - 1000
    assert langid.build(["a"], np.zeros(1001, np.int64), gram, n).masks(gram).all()


def test_languages_equal_exact_ngram_sets(spark):
    """The same rule with Python sets in place of Bloom filters: no hashing, no false positives."""
    from collections import Counter

    def spelled(text):
        return "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"

    def ngrams(text):
        s = spelled(text or "")
        return [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1) if (s[i : i + n].strip("\0") if n == 2 else "\0" not in s[i + 1 : i + n - 1])]

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    learned = docs.filter(F.col("lang").isNotNull() & (queries.id_remainder(4) != 2)).collect()
    counts: dict[str, Counter] = {}
    for r in learned:
        counts.setdefault(r["lang"], Counter()).update(ngrams(r["text"]))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    most: dict[str, float] = {}
    for k, c in counts.items():
        for g, n in c.items():
            most[g] = max(most.get(g, 0), n / totals[k])
    sets = {k: {g for g, n in c.items() if n / totals[k] >= 2e-6 and n / totals[k] >= 0.2 * most[g]} for k, c in counts.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op2_language_bitmask(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        found = ngrams(r["text"])
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]] == ("und", 0)
            continue
        share = {k: sum(g in s for g in found) / len(found) for k, s in sets.items()}
        top = sorted(share.values())[-2:]
        assert got[r["doc_id"]][1] == pytest.approx(top[-1], abs=0.08)
        if len(top) < 2 or top[-1] - top[0] > 0.1:
            assert share[got[r["doc_id"]][0]] == top[-1]


def test_positive_unlabelled_gradient_is_that_of_the_risk():
    """One step of a fit goes against the gradient of the corrected risk, worked out by differences."""
    import math

    import numpy as np

    r = np.random.default_rng(3)
    texts = lambda n, p: [np.flatnonzero(r.random(6) < p).astype(np.uint32) for _ in range(n)]
    positive, unlabelled, prior, chosen = texts(30, 0.6), texts(50, 0.3), 0.3, np.arange(6, dtype=np.uint32)
    soft = lambda z: np.logaddexp(0, z)

    def risk(w):
        z = lambda ts: np.array([w[6] + w[:6][t].sum() for t in ts])
        zp, zu = z(positive), z(unlabelled)
        return prior * soft(-zp).mean() + max(0.0, soft(zu).mean() - prior * soft(zp).mean())

    start = np.zeros(7)
    start[6] = math.log(prior / (1 - prior))
    slope = np.array([(risk(start + d) - risk(start - d)) / 2e-6 for d in np.eye(7) * 1e-6])
    model = toxicity.fit(positive, unlabelled, prior, chosen=chosen, steps=1, rate=0.05)
    moved = np.append(model.weights, model.bias) - start
    assert np.allclose(moved, -0.05 * np.sign(slope), atol=1e-4)
    before = risk(start)
    model = toxicity.fit(positive, unlabelled, prior, chosen=chosen, steps=200)
    assert risk(np.append(model.weights, model.bias)) < before
