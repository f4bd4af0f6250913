"""Fingerprints and groups against plain loops."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, simhash


def plain_hash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint():
    rng = random.Random(1)
    for t in [None, "", " \n", "A", "Ä b", "a B\x0bc\x85d", *[" ".join(rng.choices("abcdÉ", k=30)) for _ in range(40)]]:
        assert simhash.simhash(t) == plain_hash(t)


def test_jvm_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_are_complete(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps] + [0, -1]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in set(signed)], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and 0 < ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert got == want


def test_components(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(70)} | {(i, i + 1) for i in range(200, 240)}
    pairs |= {(300, 300 + i) for i in range(1, 60)}
    roots = closed(400, pairs)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    linked = {x for p in pairs for x in p}
    assert got == {x: roots[x] for x in linked if roots[x] != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def rows_of():
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(80)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(80)] = "other"
        rows.append((100 + i, " ".join(words)))
    rows += [(500 + i, base[0]) for i in range(30)] + [(700, None), (701, ""), (702, " "), (None, base[1]), (3, base[5]), (3, base[5])]
    return rows


def test_groups(spark):
    rows = rows_of()
    got = simhash.near_groups(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(4)).collect()
    prints = np.array([plain_hash(t) for _, t in rows], np.uint64)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]) <= 3]
    roots = closed(len(rows), pairs)
    least = {}
    for (key, _), r in zip(rows, roots):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    want = [(k, f"{int(p):016x}", least.get(r)) for (k, _), p, r in zip(rows, prints, roots)]
    order = lambda x: str(tuple(x))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    kept = simhash.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values()) and set(kept[0].asDict()) == {"doc_id", "text", "fp"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 0 and simhash.one_of_each(docs).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs.select(F.lit(1).alias("fp")), 4)


def test_columns_with_names_of_its_own(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = docs.select(F.col("doc_id").alias("sh_key"), F.col("text").alias("sh_text"), F.lit(7).alias("sh_at"), F.lit("x").alias("sh_id"))
    kept = simhash.one_of_each(odd, "sh_key", "sh_text").collect()
    assert sorted(r["sh_key"] for r in kept) == sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert all((r["sh_at"], r["sh_id"]) == (7, "x") for r in kept)
