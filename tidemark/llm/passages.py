"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Documents are seeded with minimisers of word k-mers, so that every intact stretch of
``kmer + window - 1`` words holds a seed that any copy of it holds as well. Seeds in a row give longer
contexts, so a passage is also found where its phrases first stand in other documents. Each seed is linked
to its first occurrence by key and position, not to all others, so a passage in a third of all documents costs
one link per seed of each. The links between a document and an earlier one are chained: ordered in both,
with a cost for gaps, the best predecessor found in a Fenwick tree. The words along a chain, fetched in
small blocks, are aligned to find the ends of the passage and its likeness.

Words are parted by ASCII blanks and compare without regard to the case of A-Z. Null and short texts
have no seeds. Rows that repeat a key are taken for one document, with the least
of their texts. Null keys take no part. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns, emit, stored

KMER, WINDOW = 5, 4  # words of a seed, seeds of which one is kept
_CONTEXT = 16  # seeds of which one is kept for longer contexts
_PART = 20  # least words of a passage, parts of a stretch
_BLOCK = 128  # words fetched together
_RANGE_BITS = 12  # leading bits of a seed's hash by which seeds are dealt
_HELD = 1 << 19  # seeds packed together
_NEAR = 24  # words at which an end is looked for one by one
_MATCHES = 8_192  # matches chained together
_MEMO = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of a word, remembered for the words of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 11)
        return value


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def column_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same hashes for a column of texts at once, one text's after the other's, and where each text's
    begin; the last of these is the number of all. Words of 32 bytes or more are hashed one by one."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, "<i8", len(texts) + 1, 8 * texts.offset)
    size = int(bounds[-1] - bounds[0])
    text = np.zeros(size + 8, np.uint8)
    if size:
        text[:size] = _LOWER[np.frombuffer(data, np.uint8, size, int(bounds[0]))]
    bounds = bounds - bounds[0]
    inside = np.zeros(size + 2, bool)  # of a word; a place is one further than in the text
    inside[1:-1] = ~_BLANK[text[:size]]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    begins[bounds] |= inside[1:][bounds]  # texts have no blanks between them
    ends[bounds] |= inside[:-1][bounds]
    at, stop = np.nonzero(begins)[0], np.nonzero(ends)[0]
    size_of = stop - at
    h = (size_of + 11).astype(np.uint64) + _XXH[5]
    eights = np.ndarray(size + 1, "<u8", text, strides=(1,))
    fours = np.ndarray(size + 5, "<u4", text, strides=(1,))
    for k in range(3):
        some = np.nonzero(size_of >= 8 * k + 8)[0]
        lane = _rotated(eights[at[some] + 8 * k] * _XXH[2], 31) * _XXH[1]
        h[some] = _rotated(h[some] ^ lane, 27) * _XXH[1] + _XXH[4]
    rest, place = size_of & 7, at + (size_of & ~7)
    some = np.nonzero(rest >= 4)[0]
    h[some] = _rotated(h[some] ^ (fours[place[some]] * _XXH[1]), 23) * _XXH[2] + _XXH[3]
    place[some] += 4
    for k in range(3):
        some = np.nonzero((rest & 3) > k)[0]
        h[some] = _rotated(h[some] ^ (text[place[some] + k] * _XXH[5]), 11) * _XXH[1]
    h = (h ^ (h >> np.uint64(33))) * _XXH[2]
    h = (h ^ (h >> np.uint64(29))) * _XXH[3]
    h ^= h >> np.uint64(32)
    for i in np.nonzero(size_of >= 32)[0].tolist():
        h[i] = xxhash.xxh64_intdigest(text[at[i] : stop[i]].tobytes(), 11)
    return h, np.searchsorted(at, bounds)


_XXH = np.array(
    [0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64
)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _kmers(words: np.ndarray, kmer: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - kmer + 1), np.uint64)
    for j in range(kmer if len(h) else 0):
        h = h * _BASE + words[j : j + len(h)]
    return _mixed(h)


def runs(words: np.ndarray, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and lengths (in k-mers) of the stretches in which one k-mer follows itself."""
    h = _kmers(words, kmer)
    at = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0] if len(h) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[at, len(h)])
    long = lengths > 1
    return at[long], h[at[long]], lengths[long]


def _minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least k-mers of all windows; of a run of one k-mer the first is kept, see runs()."""
    width = min(window, len(h))
    least, at, span = h, np.arange(len(h)), 1
    while span < width:  # the least of a window, from those of two that cover it
        step = min(span, width - span)
        right = least[step:] < least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    # Places never fall, as the first of equals is taken.
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at = at[new]
    new = np.ones(len(at), bool)
    new[1:] = h[at[1:]] != h[at[:-1]]
    return at[new]


def _numbered(h: np.ndarray) -> np.ndarray:
    """How many equal hashes stand before each."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.ones(len(h), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    starts = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    times = np.empty(len(h), np.uint64)
    times[order] = (np.arange(len(h)) - starts).astype(np.uint64)
    return times


def seeds(words: np.ndarray, kmer: int = KMER, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the minimisers. A k-mer's n-th seed in a document has a hash of its own,
    so texts that repeat themselves are matched in order."""
    if len(words) < kmer:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _kmers(words, kmer)
    at = _minimisers(h, window)
    return at, _numbered_hashes(h[at])


def _numbered_hashes(h: np.ndarray) -> np.ndarray:
    return _mixed(h + _numbered(h) * _BASE)


def contexts(words: np.ndarray, kmer: int = KMER, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Further seeds, by which a passage is found where its phrases first stand elsewhere: hashes of two
    and three sparser seeds in a row, and the seeds that repeat in the document, without their number."""
    if len(words) < kmer:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _kmers(words, kmer)
    return _contexts(h, _minimisers(h, window))


def _contexts(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    again = at[_numbered(h[at]) > 0]
    sparse = _minimisers(h, _CONTEXT)
    places, hashes = [again], [_mixed(h[again])]
    value = h[sparse]
    for n in (1, 2):
        value = _mixed(value[:-1] * _BASE + h[sparse[n:]])
        places.append(sparse[: len(value)])
        hashes.append(value)
    return np.concatenate(places), np.concatenate(hashes)


def all_seeds(words: np.ndarray, kmer: int = KMER, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The seeds and the contexts, from one look at the k-mers."""
    if len(words) < kmer:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _kmers(words, kmer)
    at = _minimisers(h, window)
    more, hashes = _contexts(h, at)
    return np.concatenate([at, more]), np.concatenate([_numbered_hashes(h[at]), hashes])


class _PrefixMax:
    """Fenwick tree for the greatest value among the first places, and where it came from."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, place: int, value: float, owner: int) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place][0]:
                self.best[place] = (value, owner)
            place += place & -place

    def upto(self, count: int) -> tuple[float, int]:
        found = (-np.inf, -1)
        while count:
            if self.best[count][0] > found[0]:
                found = self.best[count]
            count -= count & -count
        return found


def chains(
    matches: list[tuple[int, int]], weight: float = KMER, gap: float = 0.1, most_gap: int = 64
) -> list[list[tuple[int, int]]]:
    """Collinear chains of (here, there) matches, best first; each match is in one chain.

    A chain gains ``weight`` per match and pays ``gap`` per word passed over in either text; a match
    joins the chain that leaves it most. A step over more than ``most_gap`` words ends a chain.
    """
    matches = sorted(set(matches))
    places = {y: i for i, y in enumerate(sorted({y for _, y in matches}))}
    tree = _PrefixMax(len(places))
    score, before = [0.0] * len(matches), [-1] * len(matches)
    i = 0
    while i < len(matches):
        j = i
        while j < len(matches) and matches[j][0] == matches[i][0]:  # one place here: no order among them
            x, y = matches[j]
            value, owner = tree.upto(places[y])
            gain = value - gap * (x + y)
            score[j] = weight + max(0.0, gain)
            if gain > 0:
                px, py = matches[owner]
                if x - px <= most_gap and y - py <= most_gap:
                    before[j] = owner
                else:
                    score[j] = weight
            j += 1
        for m in range(i, j):
            tree.put(places[matches[m][1]], score[m] + gap * sum(matches[m]), m)
        i = j
    used, out = [False] * len(matches), []
    for end in sorted(range(len(matches)), key=lambda m: (-score[m], m)):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(matches[end])
            end = before[end]
        if chain:
            out.append(chain[::-1])
    return out


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Least number of words changed, added or left out between two stretches."""
    while len(a) and len(b) and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while len(a) and len(b) and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    row = np.arange(len(b) + 1)
    for x in a:
        best = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.concatenate([[row[0] + 1], best])
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
    return int(row[-1])


def _edits_along(x: np.ndarray, y: np.ndarray, here: np.ndarray, there: np.ndarray, at: int, there_at: int) -> int:
    """Sum of the edits between each place and the next. Places in a row that are as far apart here as there are
    compared at once, and only the steps with a word that differs are looked at."""
    apart = np.nonzero(np.diff(y - x))[0]  # steps of unlike lengths
    odd = apart.tolist()
    for i, j in zip([0, *(apart + 1).tolist()], [*odd, len(x) - 1]):
        if i < j:
            a, b = here[x[i] - at : x[j] - at], there[y[i] - there_at : y[j] - there_at]
            if len(a) != len(b):  # the words given end within
                odd += range(i, j)
            elif len(differ := np.nonzero(a != b)[0]):
                odd += np.unique(np.searchsorted(x, differ + x[i], side="right") - 1).tolist()
    return sum(
        edits(here[x[i] - at : x[i + 1] - at], there[y[i] - there_at : y[i + 1] - there_at]) for i in odd
    )


def _extend(a: np.ndarray, b: np.ndarray, drop: int = 8) -> tuple[int, int, bool]:
    """How many words of both go on alike, letting single ones differ, and how many of them differ.

    Equal words gain one and others lose two; it ends ``drop`` below the best and returns that best, and
    whether the words gave out before it ended.
    """
    n = min(len(a), len(b))
    if not n:
        return 0, 0, True
    # Most chance matches end within a few words.
    total = best = take = 0
    near = (a[: min(n, _NEAR)] == b[: min(n, _NEAR)]).tolist()
    for i, alike in enumerate(near):
        total += 1 if alike else -2
        if total > best:
            best, take = total, i + 1
        elif best - total > drop:
            return take, near[:take].count(False), False
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    below = np.nonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > drop)[0]
    stop = int(below[0]) if len(below) else n
    if not stop or total[:stop].max() <= 0:
        return 0, 0, not len(below)
    take = int(np.argmax(total[:stop])) + 1
    return take, int((~same[:take]).sum()), not len(below)


def align(
    xs: np.ndarray, ys: np.ndarray, here: np.ndarray, there: np.ndarray, at: int, there_at: int, kmer: int = KMER
) -> tuple[int, int, int, int, int, bool, bool]:
    """Start and end here and there, and edits, of the passage along a chain of places, and whether the given words
    gave out at its left and right.

    The words are given from ``at`` and ``there_at`` on. Between matches the least edits are counted;
    beyond the outer ones the passage goes on as long as the words do.
    """
    x0, y0, x, y = int(xs[0]), int(ys[0]), int(xs[-1]), int(ys[-1])
    left, cost, open_left = _extend(here[: x0 - at][::-1], there[: y0 - there_at][::-1])
    a, b = here[x0 - at : x + kmer - at], there[y0 - there_at : y + kmer - there_at]
    if a.tobytes() != b.tobytes() or len(xs) > 2 and (np.diff(ys - xs) != 0).any():
        cost += _edits_along(np.append(xs, x + kmer), np.append(ys, y + kmer), here, there, at, there_at)
    right, more, open_right = _extend(here[x - at + kmer :], there[y - there_at + kmer :])
    return x0 - left, x + kmer + right, y0 - left, y + kmer + right, cost + more, open_left, open_right


def _planes(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in as many bytes each as the greatest needs, a row per byte of all together."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(packed, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8")[:, 0]


_PACKED = pa.schema(
    [("part", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("steps", pa.binary())]
    + [("least", pa.int64()), ("keys", pa.binary()), ("at", pa.binary())]
)


def _seed_table(docs: DataFrame, kmer: int, window: int) -> DataFrame:
    """Seeds in rows of many: sorted by hash, a row per range of hashes, told by their leading bits.

    Of the sorted hashes only the steps are kept, and of the keys what they are above the least.
    """

    def packed(h: np.ndarray, keys: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h)
        h, keys, at = h[order], keys[order], at[order]
        ends = np.searchsorted(h >> np.uint64(64 - _RANGE_BITS), np.arange(1 << _RANGE_BITS, dtype=np.uint64), "right")
        parts = np.nonzero(np.diff(ends, prepend=0))[0]
        starts, ends = np.r_[0, ends[parts][:-1]], ends[parts]
        least = keys.min()
        steps = np.diff(h, prepend=h[:1])
        steps[starts] = 0
        planes = _planes(steps), _planes(keys.view(np.uint64) - least.view(np.uint64)), _planes(at)
        first = h[starts].view(np.int64).tolist()
        out = []
        for part, i, j, begin in zip(parts.tolist(), starts.tolist(), ends.tolist(), first):
            hs, ks, places = (p[:, i:j].tobytes() for p in planes)
            out.append((part, j - i, begin, hs, int(least), ks, places))
        yield from emit(out, _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            words, bounds = column_hashes(batch.column("text"))
            for key, i, j in zip(*columns(batch, "key"), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at, h = all_seeds(words[i:j], kmer, window)
                if len(at):
                    held.append((h, np.full(len(at), key, np.int64), at.astype(np.uint64)))
                    n += len(at)
                if n >= _HELD:
                    yield from packed(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield from packed(*map(np.concatenate, zip(*held)))

    return docs.mapInArrow(run, "part int, n int, first long, steps binary, least long, keys binary, at binary")


def shared(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the seeds whose hash stands in several documents, and a number of each one's hash."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    more = ~(new & np.r_[new[1:], True])  # most hashes stand once
    order, new = order[more], new[more]
    if not len(order):
        return order, order
    group = np.cumsum(new) - 1
    starts = np.nonzero(new)[0]
    several = np.logical_or.reduceat(keys[order] != keys[order[starts]][group], starts)[group]
    return order[several], group[several]


def _shared_seeds(packed: DataFrame) -> DataFrame:
    """Seeds that stand in several documents, a row each; ``h`` is a number of the hash. A task holds the
    seeds of one range of hashes at a time."""

    def seeds_of(part: int, rows: list[tuple]) -> pa.RecordBatch:
        h, keys, at = [], [], []
        for n, first, steps, least, above, places in rows:
            h.append(np.cumsum(_unpack(steps, n), dtype=np.uint64) + np.array(first).astype(np.uint64))
            keys.append((_unpack(above, n) + np.array(least).astype(np.uint64)).view(np.int64))
            at.append(_unpack(places, n).astype(np.int32))
        h, keys, at = map(np.concatenate, (h, keys, at))
        found, group = shared(h, keys)
        out = (group + (part << 48), keys[found], at[found])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["h", "key", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, *row in zip(*columns(batch, *_PACKED.names), strict=True):
                if p != part and held:
                    yield seeds_of(part, held)
                    held = []
                part = p
                held.append(row)
        if held:
            yield seeds_of(part, held)

    dealt = packed.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "h long, key long, at int")


def _word_table(docs: DataFrame, kmer: int) -> DataFrame:
    """Words of each document as 16-bit hashes, in blocks; with the first block the runs of one k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            hashes, bounds = column_hashes(batch.column("text"))
            for key, start, end in zip(*columns(batch, "key"), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                words = hashes[start:end]
                at, h, lengths = runs(words, kmer)
                found = list(zip(h.view(np.int64).tolist(), lengths.tolist(), at.tolist())) or None
                words = (words >> np.uint64(48)).astype("<u2")
                for i in range(0, len(words), _BLOCK):
                    some = words[i : i + _BLOCK].tobytes()
                    out.append((key, i // _BLOCK, some, i + _BLOCK >= len(words), None if i else found))
            yield from emit(out, _BLOCKS)

    return docs.mapInArrow(
        run, "key long, block int, words binary, last boolean, runs array<struct<h: long, length: int, at: int>>"
    )


_RUNS = pa.list_(pa.struct([("h", pa.int64()), ("length", pa.int32()), ("at", pa.int32())]))
_BLOCKS = pa.schema(
    [("key", pa.int64()), ("block", pa.int32()), ("words", pa.binary()), ("last", pa.bool_()), ("runs", _RUNS)]
)
_CHAINS = pa.schema(
    [
        ("key", pa.int64()),
        ("source", pa.int64()),
        ("x", pa.list_(pa.int32())),
        ("y", pa.list_(pa.int32())),
    ]
)


def _chain_table(hits: DataFrame, kmer: int, most_gap: int, gap: float = 0.1) -> DataFrame:
    """Chains between a document and an earlier one; any, as a passage may hold a single seed.

    Hits come sorted by document; those of whole documents are looked at together, and the last document
    waits for its rest. Hits of a document are no more than its seeds.
    """

    def found(rows: np.ndarray) -> list[tuple]:
        rows = rows[:, np.lexsort(rows[::-1])]
        other = np.ones(rows.shape[1], bool)
        other[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        key, source, x, y = rows[:, other]
        new = np.ones(len(x), bool)
        new[1:] = (key[1:] != key[:-1]) | (source[1:] != source[:-1])
        dx, dy = np.diff(x, prepend=0), np.diff(y, prepend=0)
        # Matches that all follow closely on the one before are one chain, with no search.
        close = new | (dx > 0) & (dy > 0) & (gap * (dx + dy) < kmer) & (dx <= most_gap) & (dy <= most_gap)
        starts = np.nonzero(new)[0]
        plain = np.logical_and.reduceat(close, starts).tolist()
        keys, sources, x, y = key[starts].tolist(), source[starts].tolist(), x.tolist(), y.tolist()
        out = []
        for k, s, one, i, j in zip(keys, sources, plain, starts.tolist(), [*starts[1:].tolist(), len(x)]):
            if one:
                out.append((k, s, x[i:j], y[i:j]))
            else:
                each = chains(list(zip(x[i:j], y[i:j])), float(kmer), gap, most_gap)
                out += [(k, s, [a for a, _ in c], [b for _, b in c]) for c in each]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for batch in batches:
            given = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            if not given.shape[1]:
                continue
            held.append(given)
            n += given.shape[1]
            key = int(given[0, -1])
            if n >= _MATCHES and key != last:
                rows = np.concatenate(held, axis=1)
                rest = int(np.argmax(rows[0] == key))
                if rest:
                    yield from emit(found(rows[:, :rest]), _CHAINS)
                held, n = [rows[:, rest:]], rows.shape[1] - rest
            last = key
        if held:
            yield from emit(found(np.concatenate(held, axis=1)), _CHAINS)

    dealt = hits.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, source long, x array<int>, y array<int>")


def _align_once(ids: DataFrame, blocks: DataFrame, similarity: float, part: int, kmer: int, margin: int) -> DataFrame:
    """Passages along the chains; ``open`` are those of which more words have to be fetched. ``x_last`` and
    ``y_last`` are the last blocks of the two documents, where known.

    Joins are by sorting: a few chains may ask for many blocks, so what is small in a file is not in memory."""

    def wanted(side: int, key: str, at: str):
        low = F.greatest(F.lit(0), F.element_at(at, 1) - margin)
        high = F.element_at(at, -1) + kmer + margin
        each = F.sequence((low / _BLOCK).cast("int"), F.least((high / _BLOCK).cast("int"), F.col(f"{at}_last")))
        return ids.select("chain", F.lit(side).alias("side"), F.col(key).alias("key"), F.explode(each).alias("block"))

    fetched = wanted(0, "key", "x").union(wanted(1, "source", "y")).join(
        blocks.hint("merge"), ["key", "block"]
    )
    each = F.struct("side", "block", "words", "last")
    fetched = fetched.groupBy("chain").agg(F.sort_array(F.collect_list(each)).alias("b"))

    schema = pa.schema(
        [("chain", pa.int64()), ("open", pa.bool_()), ("x_last", pa.int32()), ("y_last", pa.int32())]
        + [("doc_id", pa.int64()), ("source_id", pa.int64())]
        + [(c, pa.int32()) for c in ("start", "end", "source_start", "source_end", "edits", "seeds")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            xs, ys, fetched = (batch.column(n) for n in ("x", "y", "b"))
            side, block, packed, last = fetched.values.flatten()
            packed = packed.cast(pa.large_binary())
            data = np.frombuffer(packed.buffers()[2] or b"", "<u2")
            bounds = np.frombuffer(packed.buffers()[1], "<i8", len(packed) + 1, 8 * packed.offset) // 2
            side, block, last = side.to_numpy(), block.to_numpy(), last.to_pylist()
            x_bounds, y_bounds, b_bounds = (c.offsets.to_numpy() for c in (xs, ys, fetched))
            xs, ys = xs.values.to_numpy(), ys.values.to_numpy()
            given = columns(batch, "chain", "key", "source")
            for n, (chain, key, source) in enumerate(zip(*given, strict=True)):
                x, y = xs[x_bounds[n] : x_bounds[n + 1]], ys[y_bounds[n] : y_bounds[n + 1]]
                i, k = b_bounds[n], b_bounds[n + 1]
                j = i + int(np.searchsorted(side[i:k], 1))
                words = [data[bounds[i] : bounds[j]], data[bounds[j] : bounds[k]]]
                first = [int(block[i]) * _BLOCK, int(block[j]) * _BLOCK]
                a0, a1, b0, b1, cost, left, right = align(x, y, *words, *first, kmer)
                more, whole = False, (last[j - 1], last[k - 1])
                if left or right:
                    # The side with fewer words left ends the search; there must be more of it to fetch.
                    ends = zip(first, words, (int(x[-1]), int(y[-1])), whole)
                    before = [(int(x[0]) - first[0], first[0]), (int(y[0]) - first[1], first[1])]
                    after = [(f + len(w) - z, not end) for f, w, z, end in ends]
                    more = any(
                        is_open and all(rest for had, rest in ends if had == min(had for had, _ in ends))
                        for is_open, ends in ((left, before), (right, after))
                    )
                length = max(a1 - a0, b1 - b0)
                if more or length >= part and 1 - cost / length >= similarity:
                    ends = (int(block[i]) if end else None for i, end in zip((j - 1, k - 1), whole))
                    out.append((chain, more, *ends, key, source, a0, a1, b0, b1, cost, len(x)))
            yield from emit(out, schema)

    return ids.join(fetched.hint("merge"), "chain").mapInArrow(
        run,
        "chain long, open boolean, x_last int, y_last int, doc_id long, source_id long, start int, end int, "
        "source_start int, source_end int, edits int, seeds int",
    )


def _aligned(ids: DataFrame, blocks: DataFrame, similarity: float, part: int, kmer: int, margin: int) -> DataFrame:
    """Passages along the chains ``ids``. Where words agree up to the end of the fetched blocks, four times
    as many are fetched, until they differ or the document ends."""
    unknown = F.lit(None).cast("int")
    done, todo = None, ids.select("*", unknown.alias("x_last"), unknown.alias("y_last"))
    while True:
        spans = stored(_align_once(todo, blocks, similarity, part, kmer, margin), "spans")
        closed = spans.where("NOT open").drop("chain", "open", "x_last", "y_last")
        done = closed if done is None else done.unionByName(closed)
        if spans.where("open").isEmpty():
            return done
        rest = spans.where("open").select("chain", "x_last", "y_last")
        todo = stored(ids.join(rest.hint("merge"), "chain"), "chains")
        margin *= 4


def _run_hits(table: DataFrame) -> DataFrame:
    """Each run of one k-mer with the first run at least as long, or the longest one before where all are shorter.

    Runs of one k-mer and length are folded first, so a window holds the lengths of a k-mer, not its runs.
    """
    per = table.groupBy("h", "length").agg(F.min(F.struct("key", "at")).alias("own"))
    falling = Window.partitionBy("h").orderBy(F.desc("length"))
    per = per.withColumn("first", F.min("own").over(falling))
    # Of the lengths that first occur before all longer ones, the next shorter one is the longest run before.
    front = per.where("own.key = first.key").groupBy("h", "first").agg(F.max("length").alias("length"))
    shorter = F.lead("first").over(Window.partitionBy("h").orderBy(F.desc("length")))
    front = front.select("h", "first", shorter.alias("before"))
    per = per.select("h", "length", "first").join(front, ["h", "first"], "left")
    source = F.when(F.col("key") == F.col("first.key"), F.col("before")).otherwise(F.col("first"))
    hits = table.join(per, ["h", "length"]).withColumn("s", source).where("s.key < key")
    return hits.select("key", F.col("s.key").alias("source"), F.col("at").alias("x"), F.col("s.at").alias("y"))


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables stored meanwhile leave no shuffle files: they go as each write ends, not when the driver happens
    to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _one_per_key(rows: DataFrame) -> DataFrame:
    """The least text of each key. Only texts of repeated keys are grouped."""
    repeated = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    folded = rows.join(repeated, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    return rows.join(repeated, "key", "left_anti").unionByName(folded)


def _spans(rows: DataFrame, similarity: float, kmer: int, window: int, most_gap: int) -> DataFrame:
    """Passages along chains of seeds, of whatever length."""
    rows = _one_per_key(rows)
    blocks = stored(_word_table(rows, kmer), "blocks")
    # Seeds are by far the most data, so they are packed, exchanged once and never stored; those that stand in
    # one document only go no further.
    same = Window.partitionBy("h").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        _shared_seeds(_seed_table(rows, kmer, window))
        .withColumn("f", F.first(F.struct("key", "at")).over(same))
        .where(F.col("key") != F.col("f.key"))
        .select("key", F.col("f.key").alias("source"), F.col("at").alias("x"), F.col("f.at").alias("y"))
    )
    run_table = blocks.where("runs IS NOT NULL").select("key", F.inline("runs"))
    hits = hits.unionByName(_run_hits(run_table.select("h", "length", "at", "key")))
    chained = _chain_table(hits, kmer, most_gap).withColumn("chain", F.monotonically_increasing_id())
    return _aligned(stored(chained, "chains"), blocks, similarity, _PART, kmer, _BLOCK // 2)


def repeated_passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = 40,
    similarity: float = 0.8,
    kmer: int = KMER,
    window: int = WINDOW,
    most_gap: int = 64,
) -> DataFrame:
    """A row per passage of a document that stands in an earlier one as well.

    ``doc_id``, ``start``, ``end`` (words, end excluded), the same of the source (``source_id`` < doc_id),
    ``edits``, ``seeds`` and ``similarity``, 1 - edits / length. Passages lie in a stretch of at least
    ``least`` repeated words, which may come from several sources. Keys are integers.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")
    )
    with _shuffles_dropped(docs.sparkSession):
        spans = _spans(rows, similarity, kmer, window, most_gap)
    # Spans of a document that meet are one stretch.
    in_doc = Window.partitionBy("doc_id").orderBy("start", "end", "source_id", "source_start")
    ends = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") > ends).cast("int"), F.lit(1))
    spans = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(in_doc))
    whole = Window.partitionBy("doc_id", "run")
    length = F.max("end").over(whole) - F.min("start").over(whole)
    longest = F.greatest(F.col("end") - F.col("start"), F.col("source_end") - F.col("source_start"))
    return (
        spans.withColumn("length", length)
        .where(F.col("length") >= least)
        .withColumn("similarity", 1 - F.col("edits") / longest)
        .drop("fresh", "run", "length")
    )
