"""The registered queries at the smallest scale, and the pipeline against its own rules."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain_hash
from tidemark.llm.queries import ORACLES, QUERIES
from tools.check import canonical, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        res = duck(SF).execute(ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(df.columns, rows) == canonical(names, res.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = (before.collect(), docs.collect())
    was, now = kept["toxicity"]
    assert 0.7 * len(was) < len(now) < len(was) and {r["doc_id"] for r in now} < {r["doc_id"] for r in was}
    was, now = kept["line dedup"]
    want = plain_lines([(r["doc_id"], r["text"]) for r in was])
    gone = {(k, t): int(n) for k, t, n in want}
    lines = {str(r["doc_id"]): r["text"].count("\n") + 1 for r in was}
    assert sorted((str(r["doc_id"]), r["text"]) for r in now) == sorted(k for k, n in gone.items() if n < lines[k[0]])
    was, now = kept["near-duplicates"]
    prints = np.array([plain_hash(r["text"]) for r in was], np.uint64)
    group = list(range(len(was)))
    for _ in range(len(was)):
        new = [min(group[j] for j in np.nonzero(np.bitwise_count(p ^ prints) <= 3)[0]) for p in prints]
        if new == group:
            break
        group = new
    least = collections.defaultdict(list)
    for r, g in zip(was, group):
        least[g].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in now) == sorted(map(min, least.values()))
    was, now = kept["mixing"]
    size = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(size(now) - 1.5 * size(was)) < 0.02 * size(was)
    assert all(r["n_chars"] == len(r["text"]) for r in now)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
