"""Trees and rounds against plain loops over all pairs."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import vector_codes as V


def plain_nearest(points, entries):
    return ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)


def plain(rows, parts=4, entries=256, rounds=4):
    rows = [(k, x, l) for k, x, l in rows if x and all(v is not None and np.isfinite(v) for v in x)]
    ids = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not ids:
        return []
    length = len(ids[0][1])
    rows, ids = [[r for r in some if len(r[1]) == length] for some in (rows, ids)]
    width = -(-length // parts)

    def cut(x):
        v = [int(np.floor(1024 * np.float64(c))) for c in x] + [0] * (width * parts - length)
        return [v[p * width : (p + 1) * width] for p in range(parts)]

    points = np.array([cut(x) for _, x, _ in rows], np.int64)
    books = np.array([cut(x) for _, x, _ in ids[:entries]], np.int64).transpose(1, 0, 2)
    for _ in range(rounds):
        new = books.copy()
        for p in range(parts):
            at = plain_nearest(points[:, p], books[p])
            for e in set(at):
                new[p, e] = points[at == e, p].sum(axis=0) // (at == e).sum()
        books = new
    codes = np.stack([plain_nearest(points[:, p], books[p]) for p in range(parts)], axis=1)
    errors = [int(sum(((points[i, p] - books[p, c]) ** 2).sum() for p, c in enumerate(row))) for i, row in enumerate(codes)]
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    of = {}
    for (_, _, l), e in zip(rows, errors):
        of[l] = of.get(l, 0) + e
    return [
        (k, "".join(f"{c:02x}" for c in row), e, of[l], digest) for (k, _, l), row, e in zip(rows, codes.tolist(), errors)
    ]


def test_nearest():
    rng = np.random.default_rng(1)
    whole = 0
    for n, m, w, high in [(500, 60, 5, 9), (700, 256, 2, 300), (17, 5, 3, 2), (1, 1, 4, 9), (300, 256, 1, 40), (900, 7, 2, 10**6), (90, 90, 4, 1 << 27)]:
        points, entries = rng.integers(-high, high, (n, w)), rng.integers(-high, high, (m, w))
        tree = V.Tree(points, 16)
        nodes, labels = V.nearest(tree, V.Book(entries))
        assert (labels == plain_nearest(points, entries)[tree.order]).all()
        whole += sum(len(x) for _, x, _ in nodes)
        for at, sums in enumerate(tree.sums()):
            cuts = tree.bounds(at)
            assert all((tree.points[a:b].sum(axis=0) == s).all() for a, b, s in zip(cuts, cuts[1:], sums))
    assert whole > 0


def rows_of(n, length, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, length))
    rows = []
    for i in rng.permutation(n).tolist():
        x = (centres[i % 12] + rng.normal(0, 0.1, length)).astype(np.float32).tolist()
        rows.append((i, x, None if i % 7 == 0 else i % 3))
    return rows


@pytest.mark.parametrize("length", [8, 6, 3])
def test_rounds(spark, monkeypatch, length):
    monkeypatch.setattr(V, "_BLOCK", 400)
    rows = rows_of(700, length, length)
    rows += [rows[0], rows[0], (5, [float(c) for c in range(length)], 1), (None, rows[3][1], 2)]
    rows += [(900, None, 1), (901, [], 1), (902, [float("nan")] * length, 1), (903, [None] * length, 1), (904, [float("inf")] * length, 0), (905, [1.0] * (length + 1), 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, id int")
    got = V.compress(df.repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<double>, label string"
    rows = [(2, [0.1, 0.2], "a"), (1, [0.5, -0.2], None), (3, [0.0, 0.0], None)]
    got = V.compress(spark.createDataFrame(rows, kind))
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))
    none = V.compress(spark.createDataFrame([(1, None, "a")], kind))
    assert none.columns == got.columns and none.count() == 0
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(1, [1e12], "a")], kind))
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame(rows, kind), entries=300)
