"""Text features in long form: n-grams, vocabulary, document frequency, TF-IDF, split."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import let
from tidemark.functions.text import bigrams, clean_words, hash_bucket
from tidemark.operators.ordered import running_sum
from tidemark.session import written

# Vocabulary size and share of the training part.
MAX_FEATURES = 60_000
TRAIN_PERCENT = 80
SPLIT_SEED = 42
_WORDS = 1 << 20  # words counted at a time


def grams(text: Column) -> Column:
    """Words and word pairs of the cleaned text, tokenised once."""
    return let(clean_words(text), lambda t: F.concat(t, bigrams(t)))


def with_grams(docs: DataFrame, text: str = "text", out: str = "grams") -> DataFrame:
    """Add the n-grams; training and scoring both pass through here."""
    return docs.withColumn(out, grams(F.col(text)))


# In the operators below the n-gram expression stands inside ``explode``. Exploding a column of it
# would make the optimizer test the size of the array below the scan, and so tokenise twice.


def most_frequent(totals: DataFrame, k: int) -> DataFrame:
    """The k terms with the highest ``n``; ties by term.

    The totals are written once. A histogram of the counts, one row per distinct count, gives the count at which
    the k-th term lies. Terms above it are kept by a filter on the stored counts; only those with that
    very count are brought into the order of terms, in ranges over all tasks.
    """
    totals = written(totals, "totals")
    sizes = totals.groupBy("n").agg(F.count(F.lit(1)).alias("terms"))
    upto = sizes.withColumn("upto", F.sum("terms").over(Window.orderBy(F.col("n").desc())))
    border = upto.where(F.col("upto") >= k).orderBy(F.col("n").desc()).first()
    if border is None:
        return totals
    wanted = k - (border["upto"] - border["terms"])
    ranked = running_sum(totals.where(F.col("n") == border["n"]), [], ["term"], {"__at": F.lit(1)})
    sure = totals.where(F.col("n") > border["n"])
    return sure.unionByName(ranked.where(F.col("__at") <= wanted).drop("__at"))


def vocabulary(docs: DataFrame, k: int = MAX_FEATURES, text: str = "text") -> DataFrame:
    """The k terms with the highest total count; ties by term. No per-document step is needed."""
    totals = docs.select(F.explode(grams(F.col(text))).alias("term")).groupBy("term")
    return most_frequent(totals.agg(F.count(F.lit(1)).alias("n")), k)


def doc_freq(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many documents a term occurs."""
    return (
        docs.select(F.explode(F.array_distinct(grams(F.col(text)))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def _totals_of(lists: list[pa.ListArray]) -> Iterator[pa.RecordBatch]:
    """(term, n, df) of some documents, given as lists of their words."""
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pair = np.nonzero(doc[1:] == doc[:-1])[0]
    second = lambda key: words.take(pa.array(key % len(words)))
    both = lambda key: pc.binary_join_element_wise(words.take(pa.array(key // len(words))), second(key), " ")
    for key, of, named in ((code, doc, second), (code[pair] * len(words) + code[pair + 1], doc[pair], both)):
        if not len(key):
            continue
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        new = np.r_[True, key[1:] != key[:-1]]
        starts = np.nonzero(new)[0]
        df = np.add.reduceat((new | np.r_[True, of[1:] != of[:-1]]).astype(np.int64), starts)
        n = np.diff(np.r_[starts, len(key)])
        yield pa.RecordBatch.from_arrays([named(key[starts]), pa.array(n), pa.array(df)], names=["term", "n", "df"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0))
        size += len(held[-1].flatten())
        if size >= _WORDS:
            yield from _totals_of(held)
            held, size = [], 0
    if size:
        yield from _totals_of(held)


def term_totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n, df): total count and document frequency in one pass over the texts and one shuffle.

    A task counts the words and pairs of about ``_WORDS`` words at a time as numbers, so rows are made per term of
    these, not per occurrence.
    """
    tokens = docs.select(clean_words(F.col(text)).alias("words"))
    counted = tokens.mapInArrow(_counted, "term string, n bigint, df bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def split(docs: DataFrame, key: str, seed: int = SPLIT_SEED, percent: int = TRAIN_PERCENT) -> DataFrame:
    """Add ``is_train`` from a hash of the key: stable under retries and repartitioning."""
    return docs.withColumn("is_train", hash_bucket(F.col(key), seed) < percent)


def inverse_doc_freq(train: DataFrame, text: str = "text", k: int | None = MAX_FEATURES) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1 over the training documents, for the k most
    frequent terms."""
    totals = term_totals(train, text)
    if k is not None:
        totals = most_frequent(totals, k)
    documents = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.select(
        "term", (F.log((F.lit(1) + documents) / (F.lit(1) + F.col("df"))) + 1).alias("idf")
    )


def _counter(spark: SparkSession, terms: list[str]) -> CountVectorizerModel:
    """Counts of these terms. They go to the JVM as one text, not one by one."""
    listed = spark._jvm.org.apache.commons.lang3.StringUtils.split("\n".join(terms), "\n")
    name = "org.apache.spark.ml.feature.CountVectorizerModel"
    return CountVectorizerModel._create_from_java_class(name, listed)._set(inputCol="grams", outputCol="tf")


def vector_stages(idf: DataFrame) -> tuple[list[str], list]:
    """The terms of ``idf`` in order, and stages that turn a row's n-grams into their weighted counts of unit
    length.

    The terms and their weights go to every task, so ``idf`` is to be bounded, as ``inverse_doc_freq`` is by
    the size of the vocabulary. Without terms there are no stages.
    """
    weights = dict(idf.select("term", "idf").toPandas().itertuples(index=False, name=None))
    terms = sorted(weights)
    if not terms:
        return [], []
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([weights[t] for t in terms]), inputCol="tf", outputCol="weighted"
    )
    stages = [_counter(idf.sparkSession, terms), weigh, Normalizer(p=2.0, inputCol="weighted", outputCol="features")]
    return terms, stages


def tfidf(docs: DataFrame, idf: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, weight): tf x idf, scaled to unit length per document, one document per row.

    Terms are counted, weighted and scaled inside the document's row; neither texts nor terms are shuffled.
    """
    terms, stages = vector_stages(idf)
    if not terms:
        return docs.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).where("false")
    ready = PipelineModel(stages).transform(with_grams(docs.select(key, text), text))
    vector = F.unwrap_udt("features")
    names = F.from_json(F.lit(json.dumps(terms)), "array<string>")  # folded to one value
    places = F.filter(F.arrays_zip(vector["indices"].alias("i"), vector["values"].alias("w")), lambda x: x["w"] != 0)
    return ready.select(key, F.inline(places)).select(key, F.get(names, F.col("i")).alias("term"), F.col("w").alias("weight"))
