"""Token ids, and both packings, against plain versions and round trips."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import packing as P
from tidemark.llm.queries import vocabulary
from tidemark.llm.tokens import encoder


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["the", " and", "\n", "über", "  ", "naïve", "x" * 40, "1234", "!?", "中文", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 900, 4000]))), 0) for i in range(60)]
    rows += [(100, None, 0), (101, "", 0), (None, "no key", 0), (7, rows[7][1], 0), (7, rows[7][1], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)


def ids_of(text):
    e = encoder(vocabulary())
    return [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_library():
    e, rng = encoder(vocabulary()), random.Random(1)
    letters = "ab Z'sé  \n\t\r.,$%<|>09½ \x85 \xad'll't́中\x1c\x00😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for t in [*texts, "a <|endoftext|> b", "word " * 5000]:
        want = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want, repr(t)


def test_cost_balanced_pieces(docs):
    got = P.cost_balanced_pieces(docs, vocabulary(), 1, capacity=256, block_tokens=20_000).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    rows = docs.collect()
    for key in {r["doc_id"] for r in rows}:
        texts = [r["text"] for r in rows if r["doc_id"] == key]
        ids = ids_of(texts[0])
        pieces = sorted(by_doc[key], key=lambda r: r["start"])
        assert sum(p["length"] for p in pieces) == len(ids) * len(texts)
        assert sorted(i for p in pieces for i in range(p["start"], p["start"] + p["length"])) == sorted(
            list(range(len(ids))) * len(texts)
        )
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        ends = np.cumsum([p["length"] for p in parts])
        assert [p["offset"] for p in parts] == [0, *ends[:-1]] and ends[-1] <= 256
        padding += 256 - ends[-1]
    total = sum(r["length"] for r in got)
    assert padding <= 256 * (3 + total // 20_000 + 1)


def piece(n, key=0):
    return P.Piece(key, 0, memoryview(bytes(4 * n)), n)


def test_best_fit_is_the_plain_one():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        got = P.pack_best_fit([piece(n, i) for i, n in enumerate(sizes)], 64)
        bins = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(64 - sum(sizes[j] for j in b), k) for k, b in enumerate(bins)]
            fits = [f for f in fits if f[0] >= sizes[i]]
            if fits:
                bins[min(fits)[1]].append(i)
            else:
                bins.append([i])
        assert [[p.key for p in s] for s in got] == bins


def test_cheapest_fit_is_the_plain_one():
    rng = random.Random(6)
    for _ in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        got = P.pack_cost_balanced([piece(n, i) for i, n in enumerate(sizes)], 64, 1.0, 0.1)
        count = -(-sum(sizes) // 64)
        bins, room, cost = [[] for _ in range(count)], [64] * count, [0.0] * count
        todo = sorted((-n, i, i) for i, n in enumerate(sizes))
        order = len(sizes)
        while todo:
            n, _, key = todo.pop(0)
            n = -n
            fits = [(cost[k], k) for k in range(count) if room[k] >= n]
            if fits:
                k, take = min(fits)[1], n
            else:
                k = min(range(count), key=lambda k: (-room[k], cost[k], k))
                take = room[k]
                todo.append((take - n, order, key))
                todo.sort()
                order += 1
            bins[k].append((key, take))
            room[k] -= take
            cost[k] += P.piece_cost(take, 1.0, 0.1)
        assert [[(p.key, len(p)) for p in s] for s in got] == bins


def test_matrices_round_trip(docs, spark):
    rows = P.packed_matrices(docs, vocabulary(), 1, pad_id=9, capacity=256).collect()
    parts = {}
    for r in rows:
        ids, places = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(places) == 256 and (ids[r["n_tokens"] :] == 9).all()
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        for key, start, seg, at in zip(r["keys"], r["starts"], P.unpack(r["input_ids"], r["cu_seqlens"]), r["position_resets"]):
            assert places[at : at + len(seg)].tolist() == list(range(len(seg)))
            parts.setdefault(key, []).append((start, seg.tolist()))
    for r in docs.dropDuplicates(["doc_id"]).collect():
        copies = 3 if r["doc_id"] == 7 else 1
        got = sorted(parts[r["doc_id"]])[::copies]
        assert [i for _, seg in got for i in seg] == ids_of(r["text"])
    empty = docs.limit(0)
    assert P.packed_matrices(empty, vocabulary(), 1).count() == 0
    assert P.cost_balanced_pieces(empty, vocabulary(), 1).count() == 0
    with pytest.raises(ValueError):
        P.packed_matrices(docs, vocabulary(), 1, capacity=1 << 20)


def test_capacity_tree():
    tree, rng, held = P.CapacityTree(16), random.Random(2), {}
    for i in range(300):
        if rng.random() < 0.6:
            held[i] = (rng.randint(0, 9), i, rng.randint(1, 16))
            tree.add(held[i][2], *held[i][:2])
        else:
            need = rng.randint(1, 16)
            fits = [h for h in held.values() if h[2] >= need]
            ask = rng.choice(["cheapest", "tightest"])
            got = getattr(tree, ask)(need)
            order = (lambda h: h[:2]) if ask == "cheapest" else (lambda h: (h[2], *h[:2]))
            assert got == (min(fits, key=order) if fits else None)
            if got:
                del held[got[1]]
