"""Targets and apportionment against plain versions; what the mix takes of each document."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M
from tidemark.llm.common import word_count


def plain_targets(sizes, share=1.5, most=2):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weights = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    goal, target, free = Fraction(share) * sum(sizes.values()), {}, set(names)
    while free:
        level = (goal - sum(target.values())) / sum(weights[n] for n in free)
        over = {n for n in free if weights[n] * level > most * sizes[n]}
        if not over:
            target |= {n: weights[n] * level for n in free}
            break
        target |= {n: most * sizes[n] for n in over}
        free -= over
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    names = ["b", "a", "ä", "B", None, "hot", ""]
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(names)
        text = rng.choice([None, "", " \t\n", "w", " ".join(f"w{j}" for j in range(rng.randint(1, 300)))])
        rows.append((i % 890, text, source, "x"))
    rows += [(None, "a b c", "a", "x"), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(3)


def mixed(docs):
    return M.mix(docs.withColumn("mix_in", word_count(F.col("text"))), "mix_in", block_words=8, shard_words=4000)


def test_targets_and_taken(docs):
    got = mixed(docs).withColumn("size", word_count(F.col("text"))).collect()
    assert len(got) == docs.count()
    sizes, taken, shards = {}, {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split())
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum((p["end"] - p["start"]) * p["times"] for p in r["picks"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        shards[r["source"]] = shards.get(r["source"], 0) + 1
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]))
    for n in sizes:
        assert abs(taken[n] - want[n]) <= 8 * (2 + sizes[n] / 4000)
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"]), r["taken"]) for r in rows)
    assert key(got) == key(mixed(docs.repartition(5)).collect())


def test_take_gives_the_taken_words(docs):
    plan = mixed(docs).cache()
    rows = M.take(plan.select("doc_id", "text", "source", "source_size", "target", "taken", "picks")).collect()
    assert sum(len(r["text"].split()) for r in rows) == plan.agg(F.sum("taken")).first()[0]
    assert set(rows[0].asDict()) == {"doc_id", "text", "source"}
    whole = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert sum((r["doc_id"], r["text"]) in whole for r in rows) > len(rows) / 4
    plan.unpersist()


def test_apportion_is_by_highest_quotients(spark):
    rng = random.Random(8)
    for case in range(4):
        cells = [(chr(97 + i), i % 2, float(rng.choice([0.3, 2.5, 2.5, 7.5, 30.25])), rng.choice([2, 9, 40])) for i in range(12)]
        seats = rng.randint(0, 60)
        df = spark.createDataFrame(cells, "s string, k int, v double, cap long")
        got = {r["s"]: r["mix_quota"] for r in M.apportion(df, "v", "cap", seats, ["s", "k"]).collect()}
        won = {c[0]: 0 for c in cells}
        for _ in range(min(seats, sum(c[3] for c in cells))):
            free = [c for c in cells if won[c[0]] < c[3]]
            best = min(free, key=lambda c: (-c[2] / (2 * won[c[0]] + 1), c[0]))
            won[best[0]] += 1
        assert got == won, case


def test_empty_and_wordless(spark, docs):
    assert mixed(docs.limit(0)).count() == 0
    rows = mixed(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()
    assert rows[0]["taken"] == 0 and rows[0]["target"] == 0.0 and rows[0]["picks"] == []


def test_columns_with_names_of_its_own(spark):
    """Whatever other columns are called, they come through, and the choice is the same."""
    rows = [(i, f"s{i % 3}", 1 + i * 37 % 50) for i in range(300)]
    plain = spark.createDataFrame(rows, "doc_id long, source string, n long")
    want = sorted(map(tuple, M.mix(plain, "n").select("doc_id", "source_size", "target", "taken").collect()))
    names = ["c_shard", "mix_start", "MIX_end", "s_source", "mix_shard", "aside_0", "target"]
    odd = plain.select("doc_id", F.col("source").alias("mix_source"), F.col("n").alias("mix_size"), *[F.lit(c).alias(c) for c in names])
    got = M.mix(odd, "mix_size", source="mix_source")
    assert sorted(map(tuple, got.select("doc_id", "source_size", "target", "taken").collect())) == want
    assert set(odd.columns) - {"target"} <= set(got.columns)
    first = got.first()
    assert all(first[c] == c for c in names[:-1])
