"""Phrase fingerprints against a plain parser, the chain of documents against a loop."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import fingerprints as P


def plain_phrases(text):
    seen, start = [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.append(text[start:end])
            start = end
    return seen


def test_phrases_and_hashes():
    rng = random.Random(1)
    texts = ["", "a", "aaaaaaa", "abcabcabc", "é中😀" * 9, *["".join(rng.choices("abc é", k=200)) for _ in range(20)]]
    for t in texts:
        ends, _ = P.walk(t, set())
        phrases = plain_phrases(t)
        assert [t[a:b] for a, b in zip([0, *ends], ends)] == phrases
        alone = [int(P.phrase_hashes(p, [len(p)])[0]) for p in phrases]
        assert P.phrase_hashes(t, ends).tolist() == alone
        assert P.signature(t).tolist() == sorted(set(alone))[: P.SIGNATURE]
    long = "".join(rng.choices("abcdefgh", k=3 * P._CHUNK))
    ends, _ = P.walk(long, set())
    assert len(np.unique(P.phrase_hashes(long, ends))) > 0.99 * len(ends)
    assert P.signature(long).tolist() == np.unique(P.phrase_hashes(long, ends))[: P.SIGNATURE].tolist()


def test_likeness_nears_the_phrase_sets():
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefghij ", k=20_000))
    for cut in (0, 5_000, 10_000, 20_000):
        other = base[:cut] + "".join(rng.choices("abcdefghij ", k=20_000 - cut))
        sets = [set(P.phrase_hashes(t, P.walk(t, set())[0]).tolist()) for t in (base, other)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs(P.likeness(P.signature(base), P.signature(other)) - true) < 0.16
    assert P.likeness(P.signature(""), P.signature("")) == 1.0
    assert P.likeness(P.signature(""), P.signature("a")) == 0.0


def expected(rows):
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(P.signature, (text, edited, after))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((key, len(text), digest, P.written_out(a), P.written_out(b), P.likeness(a, b), P.likeness(a, c)))
    return out


@pytest.mark.parametrize("case", ["many", "one", "none", "nulls"])
def test_chain(spark, case):
    rng = random.Random(3)
    rows = {
        "many": [(3 * i - 50, "".join(rng.choices("ab é", k=rng.choice([0, 1, 2, 50, 700]))), "x") for i in range(90)],
        "one": [(5, "abcabd", "x")],
        "none": [],
        "nulls": [(None, "first", None), (1, None, "x"), (2, "", None), (2, "b", "y"), (2, "a", "z"), (9, "a", None), (9, "a", "q")],
    }[case]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(3)
    got = sorted(map(tuple, P.fingerprint_chain(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
    ordered = sorted(((k, t) for k, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert got == sorted(expected(ordered), key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
