"""Divergence of sources against plain loops over all terms and pairs."""

import collections
import random
import re

import pyarrow as pa

from tidemark.llm import divergence as D


def plain_terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(rows, least=3, most=200):
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    out = []
    for lang in {l for _, l, _ in rows}:
        df, all_, of = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
        for t, l, s in rows:
            if l == lang:
                found = plain_terms(t)
                of[s].update(found)
                all_.update(found)
                df.update(set(found))
        kept = [t for t in df if df[t] >= least]
        total = {s: sum(c[t] for t in kept) for s, c in of.items()}
        share = lambda n, N: 1 + 10**9 * (n + 1) // (N + len(kept))
        q_all = {t: share(all_[t], sum(all_[x] for x in kept)) for t in kept}
        p = {s: {t: share(of[s][t], total[s]) for t in kept} for s in of}
        apart = lambda a, b: (a - b) ** 2 // b
        for s in of:
            pairs = [(sum(apart(p[s][t], p[u][t]) for t in kept), u) for u in of if u != s]
            terms = [(apart(p[s][t], q_all[t]), t) for t in kept if of[s][t] and p[s][t] > q_all[t]]
            for part, items, cut in (("pair", pairs, None), ("term", terms, most)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items[:cut])]
    return sorted(out)


def rows_of():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdeÄß東", k=rng.randint(1, 3))) for _ in range(300)]
    rows = []
    for i in range(160):
        source = rng.choice(["s1", "s2", "s3", "S3", "é", None])
        own = vocabulary[hash_of(source) :: 3] if rng.random() < 0.6 else vocabulary
        text = rng.choice([" ", "-", "\n", "9"]).join(rng.choice(own).title() for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None]), source))
    rows += [(None, "en", "empty"), ("", "fr", "a"), ("one two", "fr", "b"), ("ONE", "xx", "only"), ("one one", "xx", "only"), ("one", "xx", "only")]
    return rows + rows[:5] + [rows[7]] * 20


def hash_of(source):
    return len(source or "") % 3


def test_terms():
    texts = ["", "A1b C_d", "\x00É\x7fx", "", "東京[z]~Zz", "a\u0080b c", "c", "1", "x"]
    for some in (texts, texts[1:], texts[-1:], [""], []):
        found, doc = D.terms(pa.array(["skipped", *some], pa.string()).slice(1))
        want = [(x, i) for i, t in enumerate(some) for x in plain_terms(t)]
        assert [(x.decode(), i) for x, i in zip(found.to_pylist(), doc.tolist())] == want


def test_audit(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, value string")
    for most in (200, 7, 1):
        got = D.audit(df.repartition(4), most=most).collect()
        assert sorted(map(tuple, got)) == plain(rows, most=most)


def test_flushes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "_TEXT", 300)
    monkeypatch.setattr(D, "_ROWS", 16)
    rows = rows_of()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert sorted(map(tuple, D.audit(df).collect())) == plain(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert D.audit(none).count() == 0
    one = spark.createDataFrame([("a a", "en", "s")], "text string, lang string, source string")
    assert D.audit(one).count() == 0
