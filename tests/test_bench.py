"""The bench covers the classifier, and its fit cuts weights as finely as Spark does by default."""

import inspect

import bench
from pyspark.ml.classification import GBTClassifier

from tidemark.operators import model


def test_classifier_is_in_the_bench():
    assert {"fit_classifier", "score_proba", "sink_model", "model_features"} <= set(bench.HEADLINE)


def test_default_bins(spark):
    assert inspect.signature(model.fit).parameters["bins"].default == GBTClassifier().getMaxBins()
