"""Trained operators: held-out accuracy, odd rows, and arithmetic held against slow versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfline.llm import langid, quality, toxicity
from shelfline.llm import queries as q

ODD = [(900_001, None, None), (900_002, "", "en"), (900_003, "12 -- !", "en"), (900_003, "12 -- !", "en"), (None, "the and of", "en"), (900_004, "word " * 60_000, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


def test_language_on_held_out_documents(spark, docs):
    model = langid.train(docs, q.remainder(5) != 0)
    found = langid.identify(docs, model).join(docs, "doc_id").where(q.remainder(5) == 0).toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.95
    assert found["score"].between(0, 1).all()
    odd = langid.identify(spark.createDataFrame(ODD, "doc_id long, text string, score string"), model).collect()
    assert len(odd) == len(ODD)
    by = {r.doc_id: r for r in odd}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900_001, 900_002, 900_003))
    assert by[None].lang_pred == "en" and by[900_004].lang_pred != "und"
    kept = langid.keep_confident(spark.createDataFrame(ODD, "doc_id long, text string, lang string"), model)
    assert {r.doc_id for r in kept.collect()} <= {None, 900_004} and kept.columns == ["doc_id", "text", "lang"]


def test_language_without_labels(spark, docs):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.train(none, F.lit(True)) is None
    assert [tuple(r) for r in langid.identify(none, None).collect()] == [(1, "und", 0.0)]
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(5)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(one, langid.train(one, F.lit(True))).collect()} == {"xx"}


def test_convolution_matches_a_loop():
    net = langid.ByteConvNet(["a", "b", "c"], seed=7)
    x = np.random.default_rng(1).integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    got = net.probabilities(x)
    for row, want in zip(x, got, strict=True):
        top = np.zeros(langid.FILTERS * len(langid.WIDTHS))
        for f in range(len(top)):
            width = langid.WIDTHS[f // langid.FILTERS]
            kernel = net.p["conv"][: width * langid.DEPTH, f].reshape(width, langid.DEPTH)
            top[f] = max((net.p["emb"][row[i : i + width]] * kernel).sum() for i in range(langid.WINDOW - max(langid.WIDTHS) + 1))
        z = top.clip(0) @ net.p["out"]
        assert np.allclose(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), want, atol=1e-4)


def test_windows_cover_every_byte():
    texts = ["", "a", "b" * langid.WINDOW, "c" * (langid.WINDOW * 3 + 5)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    x, owner = langid.windows(data, offs)
    assert [int((x[owner == i] > 0).sum()) for i in range(4)] == [len(t) for t in texts]


def toxic_texts(n, seed):
    draw = random.Random(seed)
    plain = ["".join(draw.choice("abcdeilnorst") for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [draw.choice(plain) for _ in range(draw.randrange(5, 200))]
        y = int(i % 3 == 0)
        for _ in range(y * (2 + len(w) // 40)):
            w[draw.randrange(len(w))] = draw.choice(["scumbag", "idiot", "vile" + draw.choice(plain)])
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_learns_words_and_prefixes(spark):
    rows = toxic_texts(500, 1)
    data, offs = toxicity.T.buffer(pa.array([r[1] for r in rows]))
    model = toxicity.fit(data, offs, np.array([r[2] for r in rows], np.float32), np.ones(len(rows), np.float32), steps=120)
    test = toxic_texts(200, 2)
    found = toxicity.scores(model, pa.array([r[1] for r in test])) >= 0.5
    assert (found == np.array([r[2] > 0 for r in test])).mean() > 0.9
    odd = toxicity.score(spark.createDataFrame(ODD, "doc_id long, text string, score string"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.keep_clean(spark.createDataFrame(ODD, "doc_id long, text string, y string"), model).columns == ["doc_id", "text", "y"]


def test_network_gradients():
    model = toxicity.BiGRU(seed=5)
    draw = np.random.default_rng(2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.p["word"] += draw.normal(0, 0.5, model.p["word"].shape)
    model.p["char"] += draw.normal(0, 0.5, model.p["char"].shape)
    data, offs = toxicity.T.buffer(pa.array(["one two three four", "x " * 60, "five"]))
    grams, first = toxicity.features(data, offs)
    y, w = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])
    g, demb, _ = model.gradients(grams, first, y, w)
    for name in ("in", "bias", "rec0", "rec1", "att", "attv", "out", "doc"):
        at = tuple(draw.integers(0, n) for n in model.p[name].shape)
        kept, sides = model.p[name][at], []
        for step in (1e-3, -1e-3):
            model.p[name][at] = kept + step
            sides.append(model.gradients(grams, first, y, w)[2])
        model.p[name][at] = kept
        assert np.isclose((sides[0] - sides[1]) / 2e-3, g[name][at], rtol=0.05, atol=2e-4), name


def test_toxicity_windows_overlap_and_cover():
    index, owner = toxicity.window_index(np.array([0, 0, 10, 200]))
    assert owner.tolist()[:2] == [0, 1]
    assert (index[0] == -1).all()
    assert sorted(set(index[owner == 2][index[owner == 2] >= 0])) == list(range(10, 200))


def test_one_label_only(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(d, labels, F.lit(True)) == 0.0 and quality.train(d, labels, F.lit(True)) == 1.0
    assert toxicity.train(d, labels.limit(0), F.lit(True)) == 0.0 and quality.train(d, labels.limit(0), F.lit(True)) == 0.5
    assert [r.score for r in quality.score(d, 0.5).collect()] == [0.5, 0.5]


def test_quality_on_held_out_documents(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels, q.remainder(3) != 1)
    found = quality.score(docs, model).join(labels, "doc_id").where(q.remainder(3) == 1).toPandas()
    assert ((found["score"] >= 0.5) == (found["quality"] == 1)).mean() > 0.93
    odd = quality.score(spark.createDataFrame(ODD, "doc_id long, text string, stats string"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_tree_arrays_match_a_walk():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees, depth = quality.grow(x, y, np.ones(400), trees=20)
    for row, z in zip(x[:40], trees.logits(x[:40], depth), strict=True):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.bound[node] else trees.right[node]
            total += trees.value[node]
        assert np.isclose(total, z)
    assert ((trees.logits(x, depth) > 0) == (y > 0)).mean() > 0.9


def test_folds_match_crc32(spark):
    ids = spark.range(200).selectExpr("id AS doc_id")
    got = [r[0] for r in ids.orderBy("doc_id").select(q.remainder(5)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in range(200)]
