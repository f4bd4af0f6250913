"""Classifier metrics over (label, pred) or (label, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running_sum


def confusion(scored: DataFrame) -> DataFrame:
    """Rows by label, columns by prediction."""
    counted = [
        F.count(F.when(F.col("pred") == p, True)).alias(f"pred_{p}") for p in (0, 1)
    ]
    return scored.groupBy("label").agg(*counted)


def _div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class, and the usual averages; 0 where undefined."""

    def cells(label, pred):
        return F.count(F.when((F.col("label") == label) & (F.col("pred") == pred), True))

    totals = scored.agg(
        cells(0, 0).alias("tn"), cells(0, 1).alias("fp"), cells(1, 0).alias("fn"), cells(1, 1).alias("tp")
    )

    def one(name, hit, wrong, missed):
        precision, recall = _div(hit, hit + wrong), _div(hit, hit + missed)
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            _div(2 * precision * recall, precision + recall).alias("f1"),
            (hit + missed).alias("support"),
        )

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    step = totals.select(
        "*", one("0", tn, fn, fp).alias("c0"), one("1", tp, fp, fn).alias("c1")
    )
    total = tn + fp + fn + tp
    share = lambda m: _div(
        F.col(f"c0.{m}") * F.col("c0.support") + F.col(f"c1.{m}") * F.col("c1.support"), total
    )
    names = ("precision", "recall", "f1")
    accuracy = _div(tn + tp, total)
    rows = F.array(
        F.col("c0"),
        F.col("c1"),
        F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(m) for m in names], total.alias("support")),
        F.struct(
            F.lit("macro avg").alias("class"),
            *[((F.col(f"c0.{m}") + F.col(f"c1.{m}")) / 2).alias(m) for m in names],
            total.alias("support"),
        ),
        F.struct(
            F.lit("weighted avg").alias("class"), *[share(m).alias(m) for m in names], total.alias("support")
        ),
    )
    return step.select(F.inline(rows))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, predicting 1 from the threshold up.

    Rows are first counted per score; the running counts over all scores are taken by range
    buckets, so no task has to hold the whole curve.
    """
    counted = scored.groupBy("score").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    counted = counted.withColumn("down", -F.col("score"))
    summed = running_sum(counted, [], ["down"], {"tp": F.col("pos"), "seen": F.col("n")})
    positives = scored.agg(F.sum(F.col("label").cast("bigint"))).scalar()
    return summed.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / F.col("seen")).alias("precision"),
        F.when(positives == 0, F.lit(1.0)).otherwise(F.col("tp") / positives).alias("recall"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """Threshold with the highest f1, the lowest one among equals; undefined points are left out."""
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total)
    best = F.max(F.when(f1.isNotNull(), F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t"))))
    return curve.agg(best.alias("b")).select(
        (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1")
    )
