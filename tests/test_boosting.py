"""Boosted trees over postings against a booster of plain loops over all documents and terms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import metrics, model

ONE, BINS = 1 << 30, 32


def plain_bin(w):
    return min(BINS - 1, max(0, math.floor(math.log2(w) * 4) + BINS))


def plain_margin(tree, doc):
    by = {s.node: s for s in tree}
    node = 0
    while by[node].term >= 0:
        s = by[node]
        right = plain_bin(doc[s.term]) >= s.bin if s.term in doc else s.absent_right
        node = 2 * node + 1 + right
    return by[node].value


def plain_fit(docs, labels, rounds, depth):
    """Every split of every node tried on every document."""
    trees = []
    margins = [0.0] * len(docs)
    for t in range(rounds):
        p = [1 / (1 + float(np.exp(-m))) for m in margins]
        g = [int(np.rint((a - y) * ONE)) for a, y in zip(p, labels)]
        h = [int(np.rint(a * (1 - a) * ONE)) for a in p]
        worth = lambda x, y: (x / ONE) * (x / ONE) / (y / ONE + 1.0)
        splits, nodes = [], {0: list(range(len(docs)))}
        for level in range(depth + 1):
            below = {}
            for node, members in sorted(nodes.items()):
                G, H = sum(g[i] for i in members), sum(h[i] for i in members)
                best = (1e-6, None)
                cells = sorted({(k, plain_bin(w)) for i in members for k, w in docs[i].items()}) if level < depth else []
                for term, bin_ in cells:
                    for absent in (False, True):
                        left = [i for i in members if not (plain_bin(docs[i][term]) >= bin_ if term in docs[i] else absent)]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if min(hl, H - hl) < ONE:
                            continue
                        gain = worth(gl, hl) + worth(G - gl, H - hl) - worth(G, H)
                        if gain > best[0]:
                            best = (gain, (term, bin_, absent, left))
                if best[1] is None:
                    splits.append(B.Split(t, node, -1, 0, False, -0.3 * (G / ONE) / (H / ONE + 1.0)))
                else:
                    term, bin_, absent, left = best[1]
                    splits.append(B.Split(t, node, term, bin_, absent, 0.0))
                    below[2 * node + 1] = left
                    below[2 * node + 2] = [i for i in members if i not in set(left)]
            nodes = below
        trees.append(splits)
        margins = [m + plain_margin(splits, d) for m, d in zip(margins, docs)]
    return trees


def rows_of(n, terms, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for _ in range(n):
        doc = {t: rng.choice([0.03, 0.11, 0.2, 0.4, 0.77, 1.0]) for t in range(terms) if rng.random() < 0.25}
        docs.append(doc)
        score = (0 in doc) + 2 * (doc.get(1, 0) > 0.3) - (2 in doc) - (3 not in doc)
        labels.append(int(score + rng.random() - 0.5 > 0))
    return docs, labels


def frame(spark, docs, labels, parts):
    rows = [([*sorted(d)], [d[t] for t in sorted(d)], y) for d, y in zip(docs, labels)]
    return spark.createDataFrame(rows, "terms array<int>, weights array<double>, label int").repartition(parts)


@pytest.mark.parametrize("parts", [1, 3])
def test_same_trees_as_plain_loops(spark, monkeypatch, parts):
    monkeypatch.setattr(B, "_BLOCK", 30)
    monkeypatch.setattr(B, "_RANGE", 4)  # the terms lie in several ranges
    docs, labels = rows_of(120, 9, 1)
    got = B.fit(frame(spark, docs, labels, parts), 9, 3, 3)
    want = plain_fit(docs, labels, 3, 3)
    shape = lambda trees: [[s[:5] for s in t] for t in trees]
    assert shape(got) == shape(want) and len(got[0]) > 3
    assert np.allclose([s.value for t in got for s in t], [s.value for t in want for s in t])
    terms = [np.array(sorted(d), np.int64) for d in docs]
    weights = [np.array([d[t] for t in sorted(d)]) for d in docs]
    margins = [sum(plain_margin(t, d) for t in want) for d in docs]
    assert np.allclose(B.probabilities(terms, weights, got, BINS), 1 / (1 + np.exp(-np.array(margins))))


def test_edges(spark):
    kind = "terms array<int>, weights array<double>, label int"
    empty = B.fit(spark.createDataFrame([], kind), 5, 2, 3)
    assert [s.value for t in empty for s in t] == [0.0, 0.0]
    blank = B.fit(spark.createDataFrame([([], [], 1)] * 9, kind), 5, 2, 3)
    assert [[s.node for s in t] for t in blank] == [[0], [0]] and all(s.value > 0 for t in blank for s in t)
    zeros = B.fit(spark.createDataFrame([([0], [0.0], i % 2) for i in range(40)], kind), 1, 1, 3)
    assert len(zeros[0]) == 1  # a weight of 0 is no posting


def test_linear_model_is_kept(spark, tmp_path):
    rows = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, "do not post spam").otherwise("welcome friends here").alias("text"),
        (1 - F.col("id") % 2).cast("int").alias("label"),
    )
    for kind in ("logistic", "trees"):
        fitted = model.fit(rows, max_features=20, rounds=5, kind=kind)
        model.save(fitted, str(tmp_path / kind))
        loaded = model.load(str(tmp_path / kind))
        assert type(loaded) is type(fitted)
        report = {r["class"]: r for r in metrics.class_report(model.score(loaded, rows)).collect()}
        assert report["accuracy"].f1 == 1.0


def test_only_the_lighter_child_is_summed(spark, monkeypatch):
    """Below the root half of the nodes are summed, over several blocks a task; the trees stay those of plain loops."""
    monkeypatch.setattr(B, "_POSTINGS", 40)
    monkeypatch.setattr(B, "_TASK", 1)
    monkeypatch.setattr(B, "_RANGE", 4)
    asked, sums_of = [], B._level_sums

    def noted(trees, growing, wanted, bins, terms):
        asked.append(wanted)
        return sums_of(trees, growing, wanted, bins, terms)

    monkeypatch.setattr(B, "_level_sums", noted)
    docs, labels = rows_of(150, 9, 2)
    got, want = B.fit(frame(spark, docs, labels, 1), 9, 2, 3), plain_fit(docs, labels, 2, 3)
    assert [[s[:5] for s in t] for t in got] == [[s[:5] for s in t] for t in want]
    assert [0] in asked and max(map(len, asked)) == 2  # of the four nodes of the last level
    assert all(len({(k - 1) // 2 for k in w}) == len(w) for w in asked)


def test_postings_dealt_by_term_exchange_no_sums(spark, monkeypatch):
    """Up to some documents, parts hold all documents of their terms; the trees stay those of plain loops."""

    def never(*_):
        raise AssertionError("sums of blocks are exchanged")

    monkeypatch.setattr(B, "_level_sums", never)
    monkeypatch.setattr(B, "_BLOCK", 40)
    monkeypatch.setattr(B, "_TASK", 100)  # several parts
    docs, labels = rows_of(150, 9, 3)
    got, want = B.fit(frame(spark, docs, labels, 3), 9, 3, 3), plain_fit(docs, labels, 3, 3)
    assert [[s[:5] for s in t] for t in got] == [[s[:5] for s in t] for t in want] and len(got[0]) > 7
    assert np.allclose([s.value for t in got for s in t], [s.value for t in want for s in t])
