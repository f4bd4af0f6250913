"""Rule classifier: TF-IDF over words and pairs, boosted trees or a linear model, stored as one folder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.textfeat import MAX_FEATURES, inverse_doc_freq, vector_stages, with_grams
from tidemark.session import written

# Size of the boosted model.
TREES, DEPTH = 100, 4


class TreeModel(NamedTuple):
    """Feature stages and boosted trees over their non-zero weights."""

    features: PipelineModel
    trees: list[list[boosting.Split]]
    bins: int


def features(train: DataFrame, text: str = "text", max_features: int = MAX_FEATURES) -> tuple[list[str], list]:
    """Terms, and stages that turn n-grams into weighted counts of unit length.

    The vocabulary and the document frequencies are those of ``textfeat``: the most frequent terms, ties
    by term, and idf = ln((1 + n) / (1 + df)) + 1. Both fit the driver by the limit of the vocabulary.
    """
    return vector_stages(inverse_doc_freq(train, text, max_features))


def _postings(df: DataFrame, *more: str) -> DataFrame:
    """The vectors' places and weights that are not zero."""
    vector = F.unwrap_udt("features")
    return df.select(vector["indices"].alias("terms"), vector["values"].alias("weights"), *more)


def fit(
    train: DataFrame,
    text: str = "text",
    label: str = "label",
    max_features: int = MAX_FEATURES,
    kind: str = "trees",
    rounds: int = TREES,
    bins: int = 32,
) -> TreeModel | PipelineModel:
    """Fit on labelled texts. ``kind`` is ``trees``, or ``logistic`` for a fast linear model.

    The feature vectors are written once, so texts are not tokenised again in each pass of the fit.
    ``bins`` is how finely the weights of a term are cut.
    """
    train = train.where(F.col(label).isNotNull())
    terms, stages = features(train, text, max_features)
    if not terms:
        raise ValueError("the labelled texts hold no term")
    ready = PipelineModel(stages).transform(with_grams(train, text)).select("features", F.col(label).alias("label"))
    if kind == "trees":
        trees = boosting.fit(_postings(ready, "label"), len(terms), rounds, DEPTH, bins)
        return TreeModel(PipelineModel(stages), trees, bins)
    classifier = LogisticRegression(maxIter=rounds, featuresCol="features", labelCol="label")
    return PipelineModel([*stages, classifier.fit(written(ready, "features"))])


def _tree_score(model: TreeModel):
    trees, bins = model.trees, model.bins

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for terms, weights in batches:
            lists = [[x.values.to_numpy(zero_copy_only=False) for x in column] for column in (terms, weights)]
            yield pa.array(boosting.probabilities(*lists, trees, bins) if len(terms) else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")


def score(model: TreeModel | PipelineModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """Add ``score``, the probability of class 1, and the hard prediction ``pred``."""
    rows = rows.drop("score", "pred")
    if isinstance(model, TreeModel):
        vector = F.unwrap_udt("features")
        scored = model.features.transform(with_grams(rows, text))
        scored = scored.withColumn("score", _tree_score(model)(vector["indices"], vector["values"]))
        return scored.select(*rows.columns, "score", (F.col("score") > 0.5).cast("int").alias("pred"))
    scored = model.transform(with_grams(rows, text))
    return scored.select(
        *rows.columns,
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("pred"),
    )


def scorer(model: TreeModel | PipelineModel):
    """Scorer of rule candidates for the extraction operators."""

    def run(candidates: DataFrame) -> DataFrame:
        return score(model, candidates, "score_text").drop("pred")

    return run


def save(model: TreeModel | PipelineModel, path: str) -> None:
    """Feature stages and trees, or the stages of the linear model, below ``path``."""
    if not isinstance(model, TreeModel):
        model.write().overwrite().save(f"{path}/linear")
        return
    model.features.write().overwrite().save(f"{path}/features")
    splits = [(*split, model.bins) for tree in model.trees for split in tree]
    kind = "tree int, node int, term int, bin int, absent_right boolean, value double, bins int"
    table = SparkSession.active().createDataFrame(splits, kind)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")


def load(path: str) -> TreeModel | PipelineModel:
    spark = SparkSession.active()
    linear = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/linear")
    if linear.getFileSystem(spark._jsc.hadoopConfiguration()).exists(linear):
        return PipelineModel.load(f"{path}/linear")
    trees: dict[int, list[boosting.Split]] = {}
    rows = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect()  # 31 nodes a tree
    for *split, bins in rows:
        trees.setdefault(split[0], []).append(boosting.Split(*split))
    return TreeModel(PipelineModel.load(f"{path}/features"), list(trees.values()), bins)
