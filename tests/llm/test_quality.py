import random
import zlib

import numpy as np

from kindred.llm import quality


def corpus(spark, n=600):
    rng = random.Random(10)
    rows, labels = [], []
    for d in range(n):
        good = d % 3 > 0
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 400))]
        text = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "###", "$$"]) for w in words)
        rows.append((d, text))
        labels.append((d, int(good)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    documents, labels, truth = corpus(spark)
    rows = quality.classify(documents, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_hard_rows(spark, hard, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (8, None), (None, 1), (11, 1), (12, 0)], "doc_id bigint, quality int")
    rows = quality.classify(hard, labels).collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.keep_good(hard, labels).columns == hard.columns
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(hard, labels.limit(0)).collect()} == {0.5}


def test_gradients():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(7, 9)).astype(np.float64)
    first, y = np.array([0, 1, 4, 7]), np.array([1.0, 0.0, 1.0])
    model = quality.Model.fresh(x, hidden=4, gate=3)
    for k in quality.Model.LEARNT:
        setattr(model, k, getattr(model, k).astype(np.float64) + 0.1)

    def loss():
        p = model.forward(x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model.gradients(x, first, y)
    for k in quality.Model.LEARNT:
        value = getattr(model, k)
        at = tuple(rng.integers(0, s) for s in value.shape)
        kept = value[at]
        value[at] = kept + 1e-5
        up = loss()
        value[at] = kept - 1e-5
        down = loss()
        value[at] = kept
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-5


def test_features_do_not_depend_on_the_batch():
    texts = ["", "short", "word " * 900, "é" * 3000, "Zz! " * 50]
    x, first = quality.encode(texts)
    for i, t in enumerate(texts):
        assert np.allclose(quality.encode([t])[0], x[first[i] : first[i + 1]])


def test_long_texts_are_encoded_in_parts():
    texts = ["", "ab cd " * 2000, "x"]
    assert np.allclose(quality.encode(texts, most=3 * quality.PASSAGE)[0], quality.encode(texts)[0])


def test_gradients_add_up_over_parts():
    rng = np.random.default_rng(12)
    count = rng.integers(1, 6, 40)
    first = np.concatenate([[0], np.cumsum(count)])
    x, y = rng.normal(size=(first[-1], 9)).astype(np.float16), (rng.random(40) < 0.5).astype(np.float32)
    whole, parts = quality.train(x, first, y, epochs=2), quality.train(x, first, y, epochs=2, most=7)
    assert all(np.allclose(getattr(whole, k), getattr(parts, k), atol=1e-3) for k in quality.Model.LEARNT)


def test_training_rows_are_bounded(spark):
    documents, labels, _ = corpus(spark, 200)
    documents = documents.union(documents)  # repeated rows count once
    rows = quality.train_rows(documents, labels, "quality", "text", "doc_id", 50, 1 << 30)
    assert rows.count() == 50 and rows.select("id").distinct().count() == 50
    texts = {r.doc_id: len(r.text) for r in documents.collect()}
    few = quality.train_rows(documents, labels, "quality", "text", "doc_id", 200, 20_000).collect()
    assert few and sum(texts[r.id] for r in few) <= 20_000
