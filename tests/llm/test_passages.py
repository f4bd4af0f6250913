"""Chaining and edits against plain programs; planted passages, exact and fuzzy, are found."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import passages as P


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_score(matches, weight=5.0, gap=0.1):
    matches, best = sorted(set(matches)), []
    for i, (x, y) in enumerate(matches):
        steps = [best[j] - gap * (x - a + y - b) for j, (a, b) in enumerate(matches[:i]) if a < x and b < y]
        best.append(weight + max([0.0, *steps]))
    return max(best)


def test_edits():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 12))], int) for _ in "ab")
        assert P.edits(a, b) == plain_edits(a.tolist(), b.tolist())


def test_chains_have_the_best_score():
    rng = random.Random(2)
    for _ in range(60):
        matches = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 40))]
        found = P.chains(matches, 5.0, 0.1, most_gap=10**6)
        assert sorted(m for c in found for m in c) == sorted(set(matches))
        for c in found:
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))
        cost = [5.0 * len(c) - 0.1 * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1]) for c in found]
        assert abs(max(cost) - plain_score(matches)) < 1e-9


def test_seeds_are_shared():
    rng = random.Random(3)
    for n in (0, 3, 5, 12, 300):
        words = np.array([rng.getrandbits(63) for _ in range(n)], np.uint64)
        at, h = P.seeds(words)
        assert len(at) == len(h) == len(set(h.tolist())) and (len(at) > 0) == (n >= 5)
    for _ in range(30):
        part = [rng.getrandbits(63) for _ in range(P.KMER + P.WINDOW - 1)]
        sides = [np.array([rng.getrandbits(63) for _ in range(40)] + part + [rng.getrandbits(63) for _ in range(30)], np.uint64) for _ in "ab"]
        assert set(P.seeds(sides[0])[1].tolist()) & set(P.seeds(sides[1])[1].tolist())


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(4)
    passage, long = words(rng, 60), words(rng, 400)
    rows, want = [], {}
    for i in range(60):
        own = words(rng, rng.randint(30, 400))
        if i % 3 == 0:  # a third of all share one passage
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() for w in passage] if i % 2 else passage
            want[i] = (at, at + 60)
        rows.append((i, " \n".join(own)))
    changed = list(long)
    for at in range(20, 400, 25):
        changed[at] = "other"
    rows += [(100, " ".join(long)), (101, " ".join(changed)), (102, " ".join(words(rng, 50) + changed[:200]))]
    rows += [(200, None), (201, ""), (202, "few words here"), (None, " ".join(long)), (203, "same " * 500), (204, "same " * 500)]
    rows += [rows[3], (300, " ".join(passage[:20]))]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, start int, block int").repartition(4)
    got = {}
    for r in P.repeated_passages(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, (a, b) in want.items():
        if i:
            spans = [(r["start"], r["end"], r["source_id"], r["edits"]) for r in got[i]]
            assert (a, b, 0, 0) in spans
    full = max(got[101], key=lambda r: r["end"] - r["start"])
    assert (full["source_id"], full["start"], full["end"], full["edits"]) == (100, 0, 400, 16)
    part = max(got[102], key=lambda r: r["end"] - r["start"])
    assert part["start"] == 50 and part["end"] == 250 and part["source_id"] in (100, 101)
    assert set(got) == {i for i in want if i} | {101, 102} | ({204} & set(got))
    assert P.repeated_passages(df.limit(0)).count() == 0


def test_repeated_source_across_blocks(spark):
    """A key's rows are one document, also where its passage crosses blocks and its rows differ."""
    rng = random.Random(5)
    passage = words(rng, 200)
    source = " ".join(words(rng, 40) + passage + words(rng, 50))
    rows = [(1, source), (1, source), (1, source), (2, " ".join(words(rng, 70) + passage)), (2, "zz later text")]
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    spans = [(r["doc_id"], r["source_id"], r["start"], r["end"], r["source_start"], r["source_end"], r["edits"]) for r in got]
    assert spans == [(2, 1, 70, 270, 40, 240, 0)]


def test_runs_of_one_word(spark):
    """Runs are found whole, with the first run at least as long, or else the longest before."""
    rng = random.Random(6)
    sizes = {1: 30, 2: 900, 3: 500, 4: 500, 5: 1200, 6: 30, 7: 2000}
    rows = [(k, " ".join(words(rng, 20) + ["same"] * n + words(rng, 20))) for k, n in sizes.items()]
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    spans = {(r["doc_id"], r["source_id"], r["end"] - r["start"]) for r in got if r["edits"] == 0}
    assert {(3, 2, 500), (4, 2, 500), (5, 2, 900), (7, 5, 1200)} <= spans
    both = [(1, "same " * 500), (2, "same " * 500)]
    got = P.repeated_passages(spark.createDataFrame(both, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["end"], r["source_start"], r["source_end"]) for r in got] == [(2, 0, 500, 0, 500)]


def test_phrases_that_first_stand_elsewhere(spark):
    """A passage links to the document that holds it, though each of its lines is in documents before."""
    rng = random.Random(7)
    rows, want = [], set()
    for trial in range(24):
        n = (18, 14, 12)[trial % 3]
        lines = [words(rng, n) for _ in range(60 // n)]
        rows += [(1000 * trial + i, " ".join(words(rng, 30) + line + words(rng, 30))) for i, line in enumerate(lines)]
        rows += [(1000 * trial + k, " ".join(words(rng, 40) + sum(lines, []) + words(rng, 40))) for k in (100, 200)]
        want.add((1000 * trial + 200, 1000 * trial + 100, 40, 40 + n * len(lines)))
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert want <= {(r["doc_id"], r["source_id"], r["start"], r["end"]) for r in got}


def test_close_edits_share_a_seed():
    """Nearly all planted passages of likeness 0.85 and more share a seed, edits close together or not."""
    rng = random.Random(8)
    for every, least in ((7, 0.97), (8, 0.99), (10, 0.99)):
        found = 0
        for _ in range(400):
            a = np.array([rng.getrandbits(63) for _ in range(60)], np.uint64)
            b = a.copy()
            b[rng.randrange(every) :: every] = rng.getrandbits(63)
            found += bool(set(P.seeds(a)[1].tolist()) & set(P.seeds(b)[1].tolist()))
        assert found >= least * 400, (every, found)


def test_seeds_are_exchanged_once_and_not_stored(spark, monkeypatch):
    """Seeds are most of what is on disk; they were stored, and exchanged for counts and for links."""
    labels, dealt = [], []
    stored, chain_table = P.stored, P._chain_table
    monkeypatch.setattr(P, "stored", lambda df, label: labels.append(label) or stored(df, label))
    monkeypatch.setattr(P, "_chain_table", lambda hits, *more: dealt.append(hits) or chain_table(hits, *more))
    texts = [(1, "a b c d e f g h " * 8), (2, "a b c d e f g h " * 8)]
    P.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string"))
    assert "seeds" not in labels
    links = dealt[0]._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    above_seeds = links.split("MapInArrow")[0]
    assert "Window" in above_seeds and "Join" not in above_seeds


def test_words_of_a_column_are_hashed_as_one_by_one():
    rng = random.Random(9)
    letters = " \t\n\x0b\x0c\r\x1c\x85\xa0 ABCZaz09é漢😀\0"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(400)]
    texts += ["", None, "a", "x" * 31, "Y" * 32, "z" * 200 + " b", "  ", "end"]
    for given in (texts, texts[:1], ["", ""], []):
        for column in (pa.array(given, pa.string()), pa.array(given, pa.string())[1:]):
            hashes, bounds = P.column_hashes(column)
            each = [P.word_hashes(t) for t in column.to_pylist()]
            assert bounds.tolist() == np.cumsum([0] + [len(w) for w in each]).tolist()
            assert hashes.tolist() == [h for w in each for h in w.tolist()]


def test_seeds_take_few_bytes_and_lose_none(spark):
    """A seed took 23 bytes of the exchange, in a row of its own."""
    rng = random.Random(10)
    texts = [(k, " ".join(words(rng, 400))) for k in (5, -(2**62), 7, 2**62, 9, 10, 11, 12)] + [(13, ""), (14, "few words")]
    df = spark.createDataFrame(texts, "key long, text string")
    got = []
    for row in P._seed_table(df.coalesce(1), P.KMER, P.WINDOW).collect():
        h = (np.cumsum(P._unpack(row["steps"], row["n"]), dtype=np.uint64) + np.uint64(row["first"] % 2**64)).tolist()
        keys = (P._unpack(row["keys"], row["n"]) + np.uint64(row["least"] % 2**64)).view(np.int64).tolist()
        assert {x >> (64 - P._RANGE_BITS) for x in h} == {row["part"]}
        got += zip(h, keys, P._unpack(row["at"], row["n"]).tolist())
    want = []
    for key, text in texts:
        for find in (P.seeds, P.contexts):
            at, h = find(P.word_hashes(text))
            want += zip(h.tolist(), [key] * len(h), at.tolist())
    assert sorted(got) == sorted(want)
    many = spark.createDataFrame([(k, " ".join(words(rng, 400))) for k in range(300)], "key long, text string")
    rows = P._seed_table(many.coalesce(1), P.KMER, P.WINDOW).collect()
    assert sum(len(r["steps"]) + len(r["keys"]) + len(r["at"]) for r in rows) <= 12 * sum(r["n"] for r in rows)


def test_plain_chains_need_no_search_and_are_the_same(spark, monkeypatch):
    rng = random.Random(11)
    hits = [(1, 0, i * 3 + 5, i * 3 + 9) for i in range(2000)] + [(2, 0, 7, 7), (2, 0, 7, 7)]
    for key in range(3, 60):
        for _ in range(rng.randint(1, 25)):
            hits.append((key, rng.randint(0, 2), rng.randint(0, 150), rng.randint(0, 150)))
    want = []
    for pair in {h[:2] for h in hits}:
        for c in P.chains([h[2:] for h in hits if h[:2] == pair]):
            want.append((*pair, [x for x, _ in c], [y for _, y in c]))
    df = spark.createDataFrame(hits, "key long, source long, x int, y int")
    monkeypatch.setattr(P, "_MATCHES", 50)
    assert sorted(map(tuple, P._chain_table(df, P.KMER, 64).collect())) == sorted(want)


def test_edits_along_are_those_of_the_steps():
    rng = random.Random(12)
    for _ in range(300):
        a = np.array([rng.randint(0, 2) for _ in range(80)], "<u2")
        b = a.copy()
        b[[rng.randrange(80) for _ in range(rng.randint(0, 4))]] = 7
        b = np.delete(b, [rng.randrange(80) for _ in range(rng.randint(0, 2))])[: rng.randint(40, 80)]
        x = np.array(sorted(rng.sample(range(76), 6)))
        y = np.sort(np.clip(x - rng.randint(0, 1) * np.array([0, 0, 0, 1, 1, 1]), 0, None))
        want = sum(P.edits(a[x[i] : x[i + 1]], b[y[i] : y[i + 1]]) for i in range(5))
        assert P._edits_along(x, y, a, b, 0, 0) == want


def test_shuffles_are_dropped_meanwhile_only(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with P._shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
