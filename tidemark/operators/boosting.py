"""Second-order boosted trees over sparse features, by histograms of the values that are there.

Documents lie in blocks. A block holds its postings (document, term, bin) in the order of (term, bin), so
the documents of a term are one slice. One Spark job fits one level of one tree: each task sums gradients and
hessians per (node, term, bin) over its blocks, the sums are shuffled by range of terms, added up, and each
range gives the best split of every node. Documents without a term need no posting: their sums are the
node's total less the rest, and they go to the side that gains more.

Below the root only the lighter child of each split is summed; the other one's sums are its parent's, kept by range of
terms for one level, less these. A term whose hessian in a node is too small for any side of a split is not kept
for the nodes below.

Up to ``_FEW`` * ``_TASK`` documents, postings are dealt by term instead: a part holds all documents of its terms, so it sums and
splits alone, and a level is a job of one stage without a shuffle. The driver then keeps margin and node of each document,
and tasks send it a bit for each document of a node, the side that it would go to.

Gradients are whole numbers of 2^-30, so sums don't depend on how the rows are partitioned, and neither do
the trees, which are the same either way. With more documents nothing is kept of each between jobs: a block finds its margins and nodes from the trees so
far, which the driver holds (at most 2^depth splits a tree). A lost task is simply run again.

Weights are cut into geometric bins, ``PER_OCTAVE`` to a doubling; the lowest one takes all smaller weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

# Learning rate, leaf penalty and least hessian of a side of a split.
RATE, PENALTY, LEAST_HESSIAN = 0.3, 1.0, 1.0
PER_OCTAVE = 4
_ONE = 1 << 30
_BLOCK = 1 << 14  # documents of a block at most, so a place in it has 16 bits
_POSTINGS = 1 << 23  # postings of a block, but for the last document's
_TASK = 1 << 19  # postings from which on sums are kept, and ranges dealt over several tasks
_PART = 8  # shares of ``_TASK`` postings of a part at most
_FEW = 2  # times ``_TASK`` documents at most have their state in the driver
_RANGE = 4096  # terms whose sums are added up together


class Split(NamedTuple):
    """A node of a tree, numbered 2k + 1 and 2k + 2 below node k: its split, or the value of a leaf.

    Documents whose weight is in ``bin`` or above go right, those with a lower one left, and those without
    the term right if ``absent_right``. A leaf has term -1.
    """

    tree: int
    node: int
    term: int
    bin: int
    absent_right: bool
    value: float


class Block:
    """Postings of some documents in the order of (term, bin)."""

    def __init__(self, slots: np.ndarray, docs: np.ndarray, n: int, bins: int):
        self.slots, self.docs, self.n, self.bins = slots, docs, n, bins

    @classmethod
    def of(cls, terms: list[np.ndarray], weights: list[np.ndarray], bins: int) -> Block:
        """From the non-zero weights of each document."""
        flat = np.concatenate(weights) if weights else np.zeros(0)
        term = np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)
        docs = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
        there = flat > 0
        level = np.floor(np.log2(flat, where=there, out=np.zeros(len(flat))) * PER_OCTAVE)
        slots = term * bins + np.clip(level + bins, 0, bins - 1).astype(np.int64)
        order = np.lexsort((docs, slots))
        order = order[there[order]]
        return cls(slots[order], docs[order], len(terms), bins)

    def turn(self, split: Split) -> np.ndarray:
        """Which documents go right."""
        right = np.full(self.n, split.absent_right)
        term = np.array([split.term, split.term + 1], self.slots.dtype) * self.bins  # of one type: nothing is copied
        a, b = np.searchsorted(self.slots, term)
        right[self.docs[a:b]] = self.slots[a:b] >= split.term * self.bins + split.bin
        return right

    def place_in(self, splits: list[Split]) -> np.ndarray:
        """The node of each document in one tree, or in the part of it that is there."""
        node = np.zeros(self.n, np.int64)
        for split in splits:  # in the order of their nodes
            if split.term >= 0:
                here = node == split.node
                if here.any():
                    node = np.where(here, 2 * node + 1 + self.turn(split), node)
        return node

    def margins(self, trees: list[list[Split]]) -> np.ndarray:
        total = np.zeros(self.n)
        for splits in trees:
            value = np.zeros(1 + max(s.node for s in splits))
            for s in splits:
                value[s.node] = s.value
            total += value[self.place_in(splits)]
        return total


_STORED = pa.schema([("distinct", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("labels", pa.binary())])
_CELLS = [("slots", pa.binary()), ("gs", pa.binary()), ("hs", pa.binary())]
_SUMS = pa.schema([("part", pa.int32()), ("node", pa.int32()), *_CELLS, ("total", pa.list_(pa.int64()))])
_BEST = pa.schema(
    [("part", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("term", pa.int64()), ("bin", pa.int32())]
    + [("absent_right", pa.bool_())] + [(c, pa.int64()) for c in ("gl", "hl", "g", "h")] + _CELLS
)
_SUMS_DDL = "part int, node int, slots binary, gs binary, hs binary, total array<bigint>"
_BEST_DDL = (
    "part int, node int, gain double, term long, bin int, absent_right boolean, gl long, hl long, g long, h long, "
    "slots binary, gs binary, hs binary"
)


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _packed(rows: DataFrame, bins: int) -> DataFrame:
    """Blocks of ``terms``, ``weights`` and ``label`` as a task reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, labels = [], [], []

        def block() -> pa.RecordBatch:
            b = Block.of(terms, weights, bins)
            starts = _starts(b.slots)
            sizes = np.diff(np.r_[starts, len(b.slots)])
            held = (b.slots[starts].astype("<i4"), sizes.astype("<i4"), b.docs.astype("<u2"), np.array(labels, "<i1"))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], schema=_STORED)

        size = 0
        for batch in batches:
            for t, w, y in zip(_column(batch, "terms"), _column(batch, "weights"), _column(batch, "label").to_pylist()):
                terms.append(t.values.to_numpy(zero_copy_only=False))
                weights.append(w.values.to_numpy(zero_copy_only=False))
                labels.append(y)
                size += len(terms[-1])
                if len(labels) == _BLOCK or size >= _POSTINGS:
                    yield block()
                    terms, weights, labels, size = [], [], [], 0
        if labels:
            yield block()

    return rows.mapInArrow(run, "distinct binary, sizes binary, docs binary, labels binary")


def _starts(values: np.ndarray) -> np.ndarray:
    """Where the stretches of equal values start."""
    return np.nonzero(np.r_[True, values[1:] != values[:-1]])[0] if len(values) else np.zeros(0, np.int64)


def _gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margins))
    return np.rint((p - labels) * _ONE), np.rint(p * (1 - p) * _ONE)


def _cells(slots: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return slots.astype("<i4").tobytes(), g.astype("<i8").tobytes(), h.astype("<i8").tobytes()


def _lasting(slot: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> tuple[np.ndarray, ...]:
    """Cells of the terms that can part off a side of a split here or below."""
    there = h > 0
    slot, g, h = slot[there], g[there], h[there]
    if not len(slot):
        return slot, g, h
    starts = _starts(slot // bins)
    enough = np.add.reduceat(h, starts) >= LEAST_HESSIAN * _ONE
    kept = np.repeat(enough, np.diff(np.r_[starts, len(slot)]))
    return slot[kept], g[kept], h[kept]


def _level_sums(trees: list[list[Split]], growing: list[Split], wanted: list[int], bins: int, terms: int):
    """Sums per (node, term, bin) of a task's blocks for the ``wanted`` nodes, in ranges of terms, with the totals
    of the nodes. Slots count from the start of their range."""
    parts = -(-max(terms, 1) // _RANGE)
    number = np.full(2 * max((s.node for s in growing), default=0) + 3, -1, np.int16)
    number[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(wanted)
        total = np.zeros((2, width), np.int64)
        held: list[tuple[np.ndarray, ...]] = []  # per wanted node: slots and sums, of the only block so far
        dense: list[np.ndarray] = []  # sums by slot, from the second block on
        for batch in batches:
            for distinct, sizes, docs, labels in zip(*(_column(batch, c).to_pylist() for c in _STORED.names)):
                y, distinct = np.frombuffer(labels, "<i1"), np.frombuffer(distinct, "<i4")
                sizes, docs = np.frombuffer(sizes, "<i4"), np.frombuffer(docs, "<u2")
                block = Block(np.repeat(distinct, sizes), docs, len(y), bins)
                both = _gradients(block.margins(trees), y)
                of = number[block.place_in(growing)]
                open_ = of >= 0
                for at, x in enumerate(both):
                    total[at] += np.bincount(of[open_], x[open_], width).astype(np.int64)
                cell = np.repeat(np.arange(len(distinct)), sizes)
                if not open_.all():
                    here = np.nonzero(open_[docs])[0]
                    docs, cell = docs[here], cell[here]
                if width > 1:
                    cell = cell + of[docs].astype(np.int64) * len(distinct)
                # Sums of whole numbers below 2^53 are exact in doubles.
                g, h = (np.bincount(cell, x[docs], width * len(distinct)).reshape(width, -1) for x in both)
                found = [np.nonzero(row)[0] for row in h]
                own = [(distinct[at], *(x[k, at].astype(np.int64) for x in (g, h))) for k, at in enumerate(found)]
                if not held and not dense:
                    held = own
                    continue
                if not dense:
                    dense = [np.zeros((width, terms * bins), np.int64) for _ in range(2)]
                for some in (held, own):
                    for k, (slots, *sums) in enumerate(some):
                        for x, s in zip(dense, sums):
                            x[k, slots] += s
                held = []
        if dense:
            found = [np.nonzero(row)[0] for row in dense[1]]
            held = [(at, *(x[k, at] for x in dense)) for k, at in enumerate(found)]
        rows = []
        for k, (slots, g, h) in enumerate(held):
            cuts = np.searchsorted(slots, np.arange(parts + 1, dtype=np.int64) * _RANGE * bins)
            for part in range(parts if total[:, k].any() else 0):
                here = slice(cuts[part], cuts[part + 1])
                cells = _cells(slots[here] - part * _RANGE * bins, g[here], h[here])
                rows.append((part, wanted[k], *cells, total[:, k].tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMS)], schema=_SUMS)

    return run


def _best_splits(wanted: list[int], sums: dict[int, tuple[int, int]], bins: int, go_on: bool):
    """The best split of each node of a level within a range of terms; ties to the lower term, then the lower bin.

    Rows are the sums of the ``wanted`` nodes, and below the root those of their parents. With ``go_on`` the nodes'
    sums are given as well."""

    def best(part: int, rows: list[dict]) -> list[tuple]:
        added = {k: (np.zeros(_RANGE * bins, np.int64), np.zeros(_RANGE * bins, np.int64)) for k in wanted}
        parents = {}
        for r in rows:
            slots = np.frombuffer(r["slots"], "<i4")
            g, h = np.frombuffer(r["gs"], "<i8"), np.frombuffer(r["hs"], "<i8")
            if r["node"] in added:
                for x, more in zip(added[r["node"]], (g, h)):
                    x[slots] += more
            else:
                parents[r["node"]] = slots, g, h
        nodes = {}
        for k in wanted:
            if not k or not parents:
                every = np.nonzero(added[k][1])[0]
                nodes[k] = every, *(x[every] for x in added[k])
            elif (k - 1) // 2 in parents:
                slots, *whole = parents[(k - 1) // 2]
                own = [x[slots] for x in added[k]]
                nodes[k] = slots, *own
                nodes[k + 1 if k % 2 else k - 1] = slots, *(w - x for w, x in zip(whole, own))
        out = []
        for k, cells in sorted(nodes.items()):
            slots, g, h = _lasting(*cells, bins)
            G, H = sums[k] if k else np.array([r["total"] for r in rows]).sum(axis=0).tolist()
            gain, term, *more = split_of(slots, g, h, G, H, bins) or (0.0, -1, 0, False, 0, 0)
            # The root tells its totals also where this range has no split of it.
            term += part * _RANGE if term >= 0 else 0
            out.append((part, k, gain, term, *more, G, H, *(_cells(slots, g, h) if go_on else (None,) * 3)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if rows:
                        yield from _emit(best(part, rows))
                    part, rows = row["part"], []
                rows.append(row)
        if rows:
            yield from _emit(best(part, rows))

    return run


def _emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BEST)], schema=_BEST)


def _worth(g, h):
    """What a leaf with these sums gains."""
    g, h = np.asarray(g) / _ONE, np.asarray(h) / _ONE
    return g * g / (h + PENALTY)


def split_of(slot: np.ndarray, g: np.ndarray, h: np.ndarray, G: int, H: int, bins: int):
    """``gain``, ``term``, ``bin``, ``absent_right`` and the left side's sums of the best split of a node
    with totals ``G`` and ``H``; nothing if none gains. ``slot`` = term * bins + bin, ascending."""
    if not len(slot):
        return None
    term = slot // bins
    starts = np.nonzero(np.r_[True, term[1:] != term[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(slot)])

    def below(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the term's lower bins, and of all its bins."""
        upto = np.cumsum(x) - x
        whole = np.add.reduceat(x, starts)
        return upto - np.repeat(upto[starts], sizes), np.repeat(whole, sizes)

    (g_low, g_all), (h_low, h_all) = below(g), below(h)
    # Without the term: left, or right.
    gl = np.stack([g_low + G - g_all, g_low], axis=1).ravel()
    hl = np.stack([h_low + H - h_all, h_low], axis=1).ravel()
    gain = _worth(gl, hl) + _worth(G - gl, H - hl) - _worth(G, H)
    gain[np.minimum(hl, H - hl) < LEAST_HESSIAN * _ONE] = -np.inf
    at = int(gain.argmax())
    if gain[at] <= 1e-6:
        return None
    return float(gain[at]), int(term[at // 2]), int(slot[at // 2] % bins), bool(at % 2), int(gl[at]), int(hl[at])


def grow(tree: int, depth: int, best_of_level) -> list[Split]:
    """One tree, its nodes in order. ``best_of_level(splits so far, nodes, sums)`` gives, for the nodes of the next
    level, their best split and sums; ``sums`` holds what is known of theirs."""
    splits: list[Split] = []
    sums: dict[int, tuple[int, int]] = {}

    def leaf(node: int) -> Split:
        g, h = sums[node]
        return Split(tree, node, -1, 0, False, -RATE * (g / _ONE) / (h / _ONE + PENALTY))

    live = {0}
    for level in range(depth):
        best = best_of_level(splits, sorted(live), sums)
        if not level:
            if 0 not in best:  # no documents at all
                return [Split(tree, 0, -1, 0, False, 0.0)]
            sums[0] = best[0][-2:]
        grown = set()
        for node in sorted(live):
            gain, term, bin_, absent, gl, hl, *_ = best.get(node, (0.0, -1, 0, False, 0, 0))
            if term < 0:
                splits.append(leaf(node))
                continue
            splits.append(Split(tree, node, term, bin_, absent, 0.0))
            g, h = sums[node]
            sums[2 * node + 1], sums[2 * node + 2] = (gl, hl), (g - gl, h - hl)
            grown |= {2 * node + 1, 2 * node + 2}
        live = grown
        if not live:
            break
    return splits + [leaf(node) for node in sorted(live)]


_COLUMN = pa.schema([("part", pa.int32()), ("first", pa.int64()), *((c, pa.binary()) for c in ("slots", "sizes", "docs"))])
_COLUMN_DDL = "part int, first long, slots binary, sizes binary, docs binary"


def _cut(first: dict[int, int], parts: int, bins: int):
    """Each block's postings by part, which is the term modulo ``parts``; documents are counted over all blocks, from
    the block's ``first`` one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, *packed in zip(*(_column(batch, c).to_pylist() for c in ("at", "distinct", "sizes", "docs"))):
                slots, sizes, docs = (np.frombuffer(x, kind) for x, kind in zip(packed, ("<i4", "<i4", "<u2")))
                part = slots // bins % parts
                of = np.repeat(part, sizes)
                docs = docs[np.argsort(of, kind="stable")].astype("<i4") + np.int32(first[at])
                cells = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[cells], np.arange(parts + 1))
                ends = np.r_[0, np.cumsum(sizes[cells])][cuts]
                for k in range(parts):
                    here = cells[cuts[k] : cuts[k + 1]]
                    if len(here):
                        held = (x.astype("<i4").tobytes() for x in (slots[here], sizes[here], docs[ends[k] : ends[k + 1]]))
                        row = (k, first[at], *held)
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _COLUMN)], schema=_COLUMN)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part, its postings in the order of (term, bin, document). Rows come by part and first document."""

    def row(part: int, rows: list[tuple]) -> pa.RecordBatch:
        slots, sizes, docs = (np.concatenate([np.frombuffer(r[i], "<i4") for r in rows]) for i in range(3))
        slots = np.repeat(slots, sizes)
        order = np.argsort(slots, kind="stable")
        slots, docs = slots[order], docs[order]
        starts = _starts(slots)
        held = (slots[starts], np.diff(np.r_[starts, len(slots)]), docs)
        cells = (part, 0, *(x.astype("<i4").tobytes() for x in held))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cells, _COLUMN)], schema=_COLUMN)

    part, rows = None, []
    for batch in batches:
        for k, *held in zip(*(_column(batch, c).to_pylist() for c in ("part", "slots", "sizes", "docs"))):
            if k != part and rows:
                yield row(part, rows)
                rows = []
            part = k
            rows.append(held)
    if rows:
        yield row(part, rows)


def _best_in_parts(gradients, place: np.ndarray, nodes: list[tuple[int, int, int]], bins: int):
    """The best split of each of the ``nodes`` (number, sums) within a task's parts, and which of the node's documents
    go right. ``place`` is the index of each document's node among these, or less than 0."""

    def run(parts: Iterator[tuple]) -> Iterator[tuple]:
        both = gradients.value
        best: dict[int, tuple] = {}
        for packed in parts:
            slots, sizes, docs = (np.frombuffer(x, "<i4") for x in packed)
            width, cells = len(nodes), len(slots)
            cell, of, held = np.repeat(np.arange(cells), sizes), place[docs], docs
            if (of < 0).any():
                here = np.nonzero(of >= 0)[0]
                cell, of, held = cell[here], of[here], docs[here]
            if width > 1:
                cell += of * np.int64(cells)
            # Sums of whole numbers below 2^53 are exact in doubles.
            sums = [np.bincount(cell, x[held], width * cells).reshape(width, -1) for x in both]
            ends = np.r_[0, np.cumsum(sizes)]
            for at, (node, G, H) in enumerate(nodes):
                there = np.nonzero(sums[1][at])[0]
                g, h = (x[at, there].astype(np.int64) for x in sums)
                found = split_of(*_lasting(slots[there], g, h, bins), G, H, bins)
                if found and (node not in best or (-found[0], found[1]) < (-best[node][0], best[node][1])):
                    _, term, bin_, absent, *_ = found
                    a, b = np.searchsorted(slots, np.array([term, term + 1], slots.dtype) * bins)
                    right = np.full(len(place), absent)
                    right[docs[ends[a] : ends[b]]] = np.repeat(slots[a:b] >= term * bins + bin_, sizes[a:b])
                    best[node] = *found, np.packbits(right[place == at]).tobytes()
        return iter(best.items())

    return run


def _fit_by_terms(blocks: DataFrame, some: int, trees: int, depth: int, bins: int) -> list[list[Split]]:
    """Trees from parts that hold all documents of their terms: no sums are exchanged, and a level is one job of one
    stage. The driver keeps the margin and the node of every document."""
    context = blocks.sparkSession.sparkContext
    first, labels, n = {}, [np.zeros(0, np.int8)], 0
    for at, held in sorted(map(tuple, blocks.select("at", "labels").collect())):
        first[at] = n
        labels.append(np.frombuffer(held, "<i1"))
        n += len(held)
    labels = np.concatenate(labels)
    slots = context.defaultParallelism
    parts = some if some < slots else slots * -(-some // (_PART * slots))
    cut = blocks.mapInArrow(_cut(first, parts, bins), _COLUMN_DDL).repartitionById(parts, F.col("part"))
    columns = written(cut.sortWithinPartitions("part", "first").mapInArrow(_joined, _COLUMN_DDL), "columns")
    # Of an RDD, as the plan of a query takes longer to make than a level to sum.
    columns = columns.select("slots", "sizes", "docs").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    margins, done = np.zeros(n), []
    try:
        for tree in range(trees):
            both = _gradients(margins, labels)
            gradients = context.broadcast(both)
            node_of = np.zeros(n, np.int32)

            def best_of_level(growing: list[Split], nodes: list[int], sums: dict[int, tuple[int, int]]) -> dict[int, tuple]:
                if not n:
                    return {}
                known = {k: sums[k] if k else tuple(int(x.sum()) for x in both) for k in nodes}
                index = np.full(2 * max(nodes) + 3, -1, np.int16)
                index[nodes] = np.arange(len(nodes))
                place = index[node_of]
                of_nodes = [(k, *known[k]) for k in nodes]
                best: dict[int, tuple] = {}
                found = columns.mapPartitions(_best_in_parts(gradients, place, of_nodes, bins)).collect()
                for node, (*split, right) in found:  # one per node and task
                    if node not in best or (-split[0], split[1]) < (-best[node][0][0], best[node][0][1]):
                        best[node] = split, right
                for node, (_, right) in best.items():
                    members = np.nonzero(node_of == node)[0]
                    node_of[members] = 2 * node + 1 + np.unpackbits(np.frombuffer(right, np.uint8), count=len(members))
                none = [0.0, -1, 0, False, 0, 0]
                return {k: (*best.get(k, (none,))[0], *known[k]) for k in nodes}

            try:
                splits = grow(tree, depth, best_of_level)
            finally:
                gradients.destroy()
            done.append(splits)
            value = np.zeros(1 + max(s.node for s in splits))
            for s in splits:
                value[s.node] = s.value
            margins += value[node_of]
    finally:
        columns.unpersist()
    return done


def fit(rows: DataFrame, terms: int, trees: int, depth: int, bins: int = 32) -> list[list[Split]]:
    """Trees of depth ``depth`` for ``label`` 0 or 1 from non-zero ``weights`` of ``terms`` (numbers below
    the given one). Rows are documents; the logistic loss starts from a margin of 0.
    """
    packed = _packed(rows.select("terms", "weights", F.col("label").cast("int").alias("label")), bins)
    blocks = written(packed.withColumn("at", F.monotonically_increasing_id()), "blocks")
    size = [F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in ("docs", "labels")]
    postings, documents = blocks.agg(*size).first()
    some = postings // (2 * _TASK) + 1  # two bytes each
    if documents <= _FEW * _TASK:
        return _fit_by_terms(blocks, some, trees, depth, bins)
    done: list[list[Split]] = []
    # Adaptive execution doesn't join ranges whose sums are kept into fewer tasks: a task per ``_TASK`` postings, and no more
    # than run at once.
    dealt = min(-(-max(terms, 1) // _RANGE), blocks.sparkSession.sparkContext.defaultParallelism, some)
    above: list[DataFrame] = []  # the level above, of which the sums of its nodes are kept

    def best_of_level(growing: list[Split], nodes: list[int], sums: dict[int, tuple[int, int]]) -> dict[int, tuple]:
        # Of the two children of a node the one with the smaller hessian.
        wanted = [k if sums[k][1] <= sums[k + 1][1] else k + 1 for k in nodes if k % 2] or [0]
        if some == 1:  # few postings are summed sooner than sums are kept
            wanted = nodes
        go_on = some > 1 and 2 * nodes[-1] + 2 < (1 << depth) - 1
        parts = blocks.mapInArrow(_level_sums(done, growing, wanted, bins, terms), _SUMS_DDL)
        if above:
            kept = above[-1].where(F.col("node").isin([(k - 1) // 2 for k in wanted]))
            none = F.lit(None).cast("array<bigint>").alias("total")
            parts = parts.unionByName(kept.select("part", "node", "slots", "gs", "hs", none))
        best = (
            parts.repartitionById(dealt, F.col("part") % dealt)
            .sortWithinPartitions("part")
            .mapInArrow(_best_splits(wanted, {k: sums[k] for k in nodes if k}, bins, go_on), _BEST_DDL)
        )
        if go_on:
            above.append(best.persist(StorageLevel.MEMORY_AND_DISK))
        found: dict[int, tuple] = {}
        for r in best.select("node", *_BEST.names[2:10]).collect():  # a row per node and range of terms
            own = tuple(r)[1:]
            now = found.get(r["node"])
            if now is None or (-own[0], own[1] < 0, own[1]) < (-now[0], now[1] < 0, now[1]):
                found[r["node"]] = own
        return found

    for tree in range(trees):
        try:
            done.append(grow(tree, depth, best_of_level))
        finally:
            while above:
                above.pop().unpersist()
    return done


def probabilities(terms: list[np.ndarray], weights: list[np.ndarray], trees: list[list[Split]], bins: int) -> np.ndarray:
    return 1 / (1 + np.exp(-Block.of(terms, weights, bins).margins(trees)))
