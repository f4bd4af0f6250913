"""Sets, signatures and groups against plain loops."""

import random

import numpy as np
import pytest

from tests.llm.test_simhash import closed
from tidemark.llm import minmax as M


def plain_set(text, k=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_groups(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    pairs = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if a and b and 100 * len(a & b) >= percent * len(a | b)
    ]
    roots, least = closed(len(rows), pairs), {}
    for (key, _), r in zip(rows, roots):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    out = []
    for (key, _), s, r in zip(rows, sets, roots):
        root = least.get(r) if s else key
        out.append((key, len(s), root, key is not None and key == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_sets():
    rng = random.Random(1)
    for t in [None, "", " \n", "A", "Ä b", "a B\x0bc\x85d e", "a b c", "a b c d", *[" ".join(rng.choices("abcÉ", k=40)) for _ in range(40)]]:
        assert len(M.shingles(t)) == len(plain_set(t))
    assert M.shingles("A b C").tolist() == M.shingles("a  B\tc").tolist()
    assert M.shingles("a b c").tolist() != M.shingles("a b c a").tolist()


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        same = []
        for _ in range(60):
            a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            b = a.copy()
            n = round(300 * (1 - share) / (1 + share))
            b[:n] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            same.append((M.signature(np.unique(a)) == M.signature(np.unique(b))).mean())
        assert abs(np.mean(same) - share) < 0.02


def test_overlaps():
    rng = np.random.default_rng(3)
    for m in (1, 2, 40):
        sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(m)]
        got = M.overlaps(sets)
        for i in range(m):
            for j in range(m):
                if i != j:
                    assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def rows_of():
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 3000)}"
    base = [[word() for _ in range(90)] for _ in range(10)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)]
    for i in range(150):  # likeness from about 0.5 to 1
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            words[rng.randrange(90)] = word()
        rows.append((100 + i, " ".join(words)))
    chain = [word() for _ in range(120)]
    for i in range(30):  # each like the next one, not like the one after some
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((900 - i, " ".join(chain)))
    rows += [(500 + i, rows[3][1].upper()) for i in range(30)]
    rows += [(700, None), (701, ""), (702, " "), (703, "only three words"), (704, "Only three\nwords"), (705, "only three words more")]
    return rows + [(None, rows[1][1]), (None, None), (None, "alone here now"), (3, rows[5][1]), (3, rows[5][1]), (700, None)]


@pytest.mark.parametrize("unit", [1024, 8])
def test_groups(spark, monkeypatch, unit):
    monkeypatch.setattr(M, "_UNIT", unit)  # small units: groups go over many
    rows = rows_of()
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, key string, node int, digest string")
    assert order(M.near_groups(df.repartition(4)).collect()) == order(plain_groups(rows))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_groups(docs).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert order(M.near_groups(none).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
