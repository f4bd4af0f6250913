"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts, each a bounded sample, train a logistic model in numpy. The
risk of the negative class is estimated from the unlabelled texts less the share of positives among
them, given by the class prior, and is kept from going below zero. Features are words and their first
letters, chosen by how much more often toxic texts have them, and counted up to three times; the model
is a few thousand weights, so whole texts are scored in one pass over the table without a shuffle.

A null text counts as empty; it and texts without letters get the score of the bias alone. Labels that
repeat a key count once, toxic if any of them is. Rows with a null key are scored and never learned
from. Without a confirmed toxic text there is nothing to learn and every score is 0. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns, stored

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5)
_LEVELS = 3
_MEMO = 300_000  # words whose features a worker remembers


def features(word: str) -> list[str]:
    """A word, and its beginnings marked by a dash."""
    return [word, *[word[:n] + "-" for n in _PREFIXES if len(word) > n]]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, _LEVELS)))
    bias: float = -math.inf  # nothing learned: score 0

    def counter(self) -> Memo:
        return Memo({n: i for i, n in enumerate(self.names)})


class Memo(dict):
    """Known features of a word, remembered for the words of late."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word):
        found = tuple(self.index[f] for f in features(word) if f in self.index)
        if len(self) >= _MEMO:
            self.clear()
        self[word] = found
        return found

    def counts(self, text: str | None) -> Counter:
        """How many words of a text have each known feature."""
        out: Counter = Counter()
        for found in filter(None, map(self.__getitem__, words(text))):
            out.update(found)
        return out


def score(model: Model, counts: Counter) -> float:
    total = model.bias + sum(model.weights[f, : min(n, _LEVELS)].sum() for f, n in counts.items())
    return 1.0 / (1.0 + math.exp(-total)) if total > -500 else 0.0


class _Table:
    """Sparse rows: which document has which weight."""

    def __init__(self, rows: list[list[int]], n_weights: int):
        self.n, self.size = len(rows), n_weights
        self.doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.at = np.array([i for r in rows for i in r], np.int64)

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.doc, w[self.at], self.n)

    def gradient(self, g: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the mean over documents, with each document's derivative by its score."""
        return np.bincount(self.at, g[self.doc], self.size) / self.n, float(g.mean())


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_nnpu(
    positive: _Table, unlabelled: _Table, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative positive-unlabelled risk with logistic loss, by Adam.

    risk = prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]). Where the second part would be
    negative, a step makes it larger instead.
    """
    w, b = np.zeros(positive.size), math.log(prior / (1 - prior))
    m, v = np.zeros(positive.size + 1), np.zeros(positive.size + 1)
    for step in range(1, steps + 1):
        zp, zu = positive.scores(w, b), unlabelled.scores(w, b)
        negative = _softplus(zu).mean() - prior * _softplus(zp).mean()
        up_w, up_b = unlabelled.gradient(_sigmoid(zu))
        un_w, un_b = positive.gradient(prior * _sigmoid(zp))
        if negative >= 0:
            pos_w, pos_b = positive.gradient(-prior * _sigmoid(-zp))
            gw, gb = pos_w + up_w - un_w, pos_b + up_b - un_b
        else:
            gw, gb = un_w - up_w, un_b - up_b
        g = np.append(gw + decay * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def is_held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text is divisible by the number of folds; false for null."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def _chosen(key: Column, share: float) -> Column:
    """A share of the keys by hash: the same rows each time, at every size."""
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < int(share * (1 << 30))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_positive: int = 2_000,
    most_unlabelled: int = 8_000,
    most_features: int = 4_000,
    precision: float = 0.5,
) -> Model:
    """Fit on about ``most_positive`` confirmed toxic and ``most_unlabelled`` other sampled texts.

    Only labels outside the held-out fold are seen, and no text of that fold is learned from. Their
    share of toxic keys is the class prior. Both samples are taken by hash of the key.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("y")).where("key IS NOT NULL AND y IS NOT NULL")
    known = known.where(~is_held_out(F.col("key"))).groupBy("key").agg(F.max("y").alias("y"))
    n_known, n_toxic = known.agg(F.count("*"), F.sum((F.col("y") == 1).cast("int"))).first()
    if not n_toxic:
        return Model()
    prior = min(max(n_toxic / n_known, 1e-3), 0.5)
    toxic = known.where("y = 1").where(_chosen(F.col("key"), min(1.0, most_positive / n_toxic))).select("key")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("key").isNotNull() & ~is_held_out(F.col("key")))
    n_docs = rows.select("key").count()
    if not n_docs:
        return Model()
    other = _chosen(F.struct("key"), min(1.0, most_unlabelled / n_docs))
    # The sampled toxic keys are bounded by the parameter.
    sample = rows.join(F.broadcast(toxic.withColumn("p", F.lit(True))), "key", "left").select(
        "key", "text", F.coalesce("p", F.lit(False)).alias("p"), other.alias("u")
    )
    sample = stored(sample.where("p OR u"), "sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (value,) in zip(*columns(batch, "text"), strict=True):
                found = {f for w in set(words(value)) for f in features(w)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["f"])

    counted = sample.where("p").select("text").mapInArrow(present, "f string").groupBy("f").agg(F.count("*").alias("n"))
    n_p, n_u = sample.agg(F.sum(F.col("p").cast("int")), F.sum(F.col("u").cast("int"))).first()
    if not n_p or not n_u:
        return Model()
    least = max(3, n_p // 200)
    in_p = {r["f"]: r["n"] for r in counted.where(F.col("n") >= least).collect()}  # bounded by the sample
    index = {f: i for i, f in enumerate(sorted(in_p))}

    def known_counts(batches: Iterator[pa.RecordBatch], index: dict[str, int]) -> Iterator[pa.RecordBatch]:
        memo = Memo(index)
        for batch in batches:
            found, times = [], []
            for (value,) in zip(*columns(batch, "text"), strict=True):
                c = memo.counts(value)
                found.append(list(c))
                times.append(list(c.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["f", "n"]
            )

    def counts(part: str, index: dict[str, int]) -> DataFrame:
        run = lambda batches: known_counts(batches, index)
        return sample.where(part).select("text").mapInArrow(run, "f array<int>, n array<int>")

    def tally(part: str) -> np.ndarray:
        """Texts of a part that have a feature at least once, twice, ..."""
        pairs = counts(part, index).select(F.explode(F.arrays_zip("f", "n")).alias("x"))
        level = F.least(F.col("x.n"), F.lit(_LEVELS))
        out = np.zeros((len(index), _LEVELS))
        for r in pairs.groupBy("x.f", level.alias("n")).count().collect():  # bounded by the sample
            out[r["f"], : r["n"]] += r["count"]
        return out

    # Kept: a feature at a level where, by the prior, most texts that have it are toxic, also if it has
    # met more toxic texts than it should by one standard deviation.
    found = tally("p")
    a, b = found / n_p, (tally("u") + 0.5) / (n_u + 1.0)
    lift = (a - b) / np.sqrt(b * (1 - b) / n_p)
    lift[(found < least) | (prior * (found - np.sqrt(found)) / n_p < precision * b)] = -np.inf
    best = np.argsort(-lift, axis=None, kind="stable")[:most_features]
    best = best[np.isfinite(lift.reshape(-1)[best])]
    if not len(best):
        return Model()
    all_names = list(index)
    names = [all_names[i] for i in sorted(set(best // _LEVELS))]
    kept = {f: i for i, f in enumerate(names)}
    used = np.zeros((len(names), _LEVELS), bool)
    for i in best:
        used[kept[all_names[i // _LEVELS]], i % _LEVELS] = True

    def rows_of(part: str) -> _Table:
        rows = [
            [f * _LEVELS + j for f, n in zip(r["f"], r["n"]) for j in range(min(n, _LEVELS)) if used[f, j]]
            for r in counts(part, kept).collect()  # bounded by the sample and the kept features
        ]
        return _Table(rows, len(names) * _LEVELS)

    w, bias = fit_nnpu(rows_of("p"), rows_of("u"), prior)
    return Model(names, w.reshape(-1, _LEVELS), bias)


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.counter()
        for batch in batches:
            (texts,) = columns(batch, "text")
            scores = [score(model, memo.counts(t)) for t in texts]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "held_out")]
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(scores), predicted], names=["key", "held_out", "score", "predicted"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("key"), is_held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model doesn't call toxic."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.counter()
        for batch in batches:
            clean = [score(model, memo.counts(t)) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
