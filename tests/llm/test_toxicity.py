"""The risk estimator against plain formulas; held-out accuracy; odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T


def made(n=900, seed=1):
    rng = random.Random(seed)
    common = ["".join(rng.choices("aeinorst", k=rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(20, 200))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbug", "grumbugs", "vilespit", "Vilespitter"]))
        rows.append((i, " ".join(words), "en", "s"))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in T.score_texts(docs, T.train(docs, known)).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    test = [(y, got[k]) for k, _, y in labels if got[k]["held_out"]]
    assert np.mean([r["predicted"] == y for y, r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    kept = T.keep_clean(docs, T.train(docs, known))
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got.values())


def test_held_out_labels_are_not_seen(spark):
    rows, labels = made(500, 2)
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    one = T.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    turned = [(k, q, 1 - y if held(k) else y) for k, q, y in labels]
    two = T.train(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert one.names == two.names and np.allclose(one.weights, two.weights)


def test_odd_rows(spark):
    rows, labels = made(300, 3)
    rows = [*[r[:2] for r in rows], (None, "grumbug grumbug vilespit"), (1000, None), (1001, ""), (1002, "12 !"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels += [(None, 1, 1), (7, 1, None), (2000, 1, 1), labels[0]]
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = T.score_texts(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["predicted"] == 1 and by[None]["held_out"] is False
    base = T._sigmoid(np.array(model.bias))
    assert all(by[k]["score"] == pytest.approx(base) for k in (1000, 1001, 1002))
    assert T.score_texts(docs.limit(0), model).count() == 0
    nothing = T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.score_texts(docs, nothing).agg(F.max("score")).first()[0] == 0.0
    assert T.train(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).names == []


def test_risk_goes_down_and_stays_above_zero():
    rng = np.random.default_rng(1)
    positive = [[0] + ([1] if rng.random() < 0.3 else []) for _ in range(50)]
    unlabelled = [([0] if rng.random() < 0.1 else []) + ([1] if rng.random() < 0.3 else []) for _ in range(400)]
    w, b = T.fit_nnpu(T._Table(positive, 2), T._Table(unlabelled, 2), 0.1)
    assert w[0] + b > 0 > b and abs(w[1]) < w[0] / 2
    z = T._Table(positive, 2).scores(w, b)
    assert z == pytest.approx([b + sum(w[i] for i in r) for r in positive])
    assert T.score(T.Model(["a"], np.array([[1.0, 2.0, 4.0]]), -1.0), {0: 2}) == pytest.approx(1 / (1 + math.exp(-2)))
