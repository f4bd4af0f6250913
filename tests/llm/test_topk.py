"""Exact top-k against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk


def plain(rows, k, every):
    ints = []
    for key, v in rows:
        if key is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints.append((key, [math.floor(1024 * x) for x in v]))
    out = []
    for q, a in ints:
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), c) for c, b in ints if c != q and len(a) == len(b)]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "ties", "odd", "large", "empty"])
def test_top_k(spark, case):
    rng = np.random.default_rng(7)
    kind = "array<float>" if case == "random" else "array<double>"
    if case == "random":
        rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(400)]
    elif case == "ties":
        rows = [(i, [1.0, 0.5] if i % 3 else [float(i % 5), -1.0]) for i in range(200)]
    elif case == "large":
        rows = [(i, [float(x) for x in rng.normal(size=3) * 1e5]) for i in range(60)]
    elif case == "odd":
        rows = [(0, [1.0, 2.0]), (10, None), (20, [None, 1.0]), (30, [math.nan, 1.0]), (40, [math.inf, 1.0]), (50, [])]
        rows += [(60, [1.0, 2.0, 3.0]), (61, [0.0, 2.0, 3.0]), (None, [1.0, 2.0]), (70, [-1.0, -2.0]), (3, [0.1, 0.2]), (80, [0.0, 0.0])]
    else:
        rows = []
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], f"vec_id long, embedding {kind}, lane int").repartition(5)
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 10 == 0, k=7).collect()))
    assert got == plain(rows, 7, 10)


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("id") == 0, k=2).collect()))
    assert got == sorted(2 * [(0, 1, 2, 3 << 20), (0, 2, 1, 2 << 20)])


def test_no_vectors_through_the_driver(spark, monkeypatch):
    """Stored blocks of like vectors are small files; their joins are no broadcasts all the same."""
    plans, written = [], topk.stored

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(topk, "stored", noted)
    rows = [(i, [1.0, float(i % 2), 40.0 if i == 7 else 0.0]) for i in range(300)]  # of two and of four bytes a value
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = topk.top_k(df, F.col("id") % 10 == 0, k=7)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, got.collect())) == plain(rows, 7, 10)
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("BroadcastExchange" in p for p in plans)
