"""Frequent terms and TF-IDF against plain loops."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import textfeat as X

TEXTS = ["No spam, no ads", "be kind and be nice", "", None, "no personal attacks", "a b c", "be kind", "No no no no", "kind ads"]


def plain_grams(text):
    t = [w for w in "".join(c for c in (text or "").lower() if c.isalnum() or c == " ").split() if len(w) > 1]
    return t + [" ".join(p) for p in zip(t, t[1:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string").repartition(3)


@pytest.mark.parametrize("k", [1, 3, 5, 8, 1000])
def test_most_frequent(docs, k):
    """The border lies among terms of one count; with a large k all terms are kept."""
    counts = collections.Counter(g for t in TEXTS for g in plain_grams(t))
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    got = X.vocabulary(docs, k)
    assert sorted((r.term, r.n) for r in got.collect()) == sorted(want)


def test_most_frequent_of_nothing(docs):
    assert X.vocabulary(docs.limit(0), 3).count() == 0


@pytest.mark.parametrize("k", [4, 1000])
def test_tfidf(docs, k):
    counts = collections.Counter(g for t in TEXTS for g in plain_grams(t))
    vocabulary = {t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]}
    df = collections.Counter(g for t in TEXTS for g in set(plain_grams(t)) & vocabulary)
    idf = {t: math.log((1 + len(TEXTS)) / (1 + n)) + 1 for t, n in df.items()}
    want = {}
    for i, t in enumerate(TEXTS):
        raw = {g: n * idf[g] for g, n in collections.Counter(plain_grams(t)).items() if g in vocabulary}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        want |= {(i, g): w / norm for g, w in raw.items()}
    got = X.tfidf(docs.withColumn("grams", F.lit(1)), X.inverse_doc_freq(docs, k=k), "k")
    found = {(r.k, r.term): r.weight for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-12 for x in want)
    none = X.tfidf(docs, X.inverse_doc_freq(docs.limit(0), k=k), "k")
    assert none.columns == ["k", "term", "weight"] and none.count() == 0


@pytest.mark.parametrize("words", [1, 5, 1 << 20])
def test_term_totals_make_no_row_per_occurrence(spark, docs, monkeypatch, words):
    monkeypatch.setattr(X, "_WORDS", words)
    rows = docs.unionByName(docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]).limit(2))
    got = X.term_totals(rows)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    n = collections.Counter(g for t in TEXTS for g in plain_grams(t))
    df = collections.Counter(g for t in TEXTS for g in set(plain_grams(t)))
    assert {r.term: (r.n, r.df) for r in got.collect()} == {g: (n[g], df[g]) for g in n}
    assert X.term_totals(docs.limit(0)).count() == 0
