"""Packing of whole tokenised documents into sequences of bounded length, by two methods.

Both work in blocks: a task reads its rows in order and packs about ``block_tokens`` of them at a
time, so memory is bounded, nothing is shuffled and at most one sequence's worth of padding per block
is left. A lost task is run again over the same rows and gives the same sequences.

Every id of a document, its closing id included, lies in exactly one piece, also for null and empty
texts (one closing id). Repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import columns, emit
from tidemark.llm.tokens import encoder

# Ids of a piece are handed on as little-endian unsigned 32-bit integers.
_ID = np.dtype("<u4")


@dataclass(frozen=True)
class Piece:
    """Part of a document: its key, first id's position, bytes of the ids, the document's length."""

    key: object
    start: int
    ids: memoryview
    total: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.key, self.start, self.ids[: 4 * n], self.total),
            Piece(self.key, self.start + n, self.ids[4 * n :], self.total),
        )


class CapacityTree:
    """Sequences by remaining capacity; each leaf holds the sequences with one capacity.

    A node holds the least (cost, sequence) below it, so both the best fit (smallest capacity that is
    large enough) and the cheapest fit (least cost among those) are found in steps of the tree's height.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.best: list[tuple | None] = [None] * (2 * self.size)
        self.leaf: dict[int, list[tuple]] = {}

    def _lift(self, room: int) -> None:
        at, held = self.size + room, self.leaf.get(room)
        self.best[at] = held[0] if held else None
        at >>= 1
        while at:
            a, b = self.best[2 * at], self.best[2 * at + 1]
            self.best[at] = b if a is None else a if b is None else min(a, b)
            at >>= 1

    def add(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.leaf.setdefault(room, []), (cost, sequence, room))
        self._lift(room)

    def _take(self, found: tuple) -> tuple:
        heapq.heappop(self.leaf[found[2]])
        self._lift(found[2])
        return found

    def cheapest(self, need: int) -> tuple | None:
        """Take the sequence of least cost that has room for ``need``."""
        low, high, found = self.size + need, 2 * self.size - 1, None
        while low <= high:
            if low & 1:
                found = min(filter(None, (found, self.best[low])), default=None)
                low += 1
            if not high & 1:
                found = min(filter(None, (found, self.best[high])), default=None)
                high -= 1
            low, high = low >> 1, high >> 1
        return self._take(found) if found else None

    def tightest(self, need: int) -> tuple | None:
        """Take the sequence with the least room that still holds ``need``."""
        at = self.size + need
        while self.best[at] is None:
            while at & 1:  # a right child: go up until there is a right neighbour
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.best[2 * at] is not None else 2 * at + 1
        return self._take(self.best[at])

    def roomiest(self) -> tuple | None:
        """Take a sequence with the most room."""
        if self.best[1] is None:
            return None
        at = 1
        while at < self.size:
            at = 2 * at + 1 if self.best[2 * at + 1] is not None else 2 * at
        return self._take(self.best[at])


def descending(pieces: list[Piece]) -> list[tuple[int, int, Piece]]:
    """As a heap: longest first, then in order of arrival."""
    heap = [(-len(p), i, p) for i, p in enumerate(pieces)]
    heapq.heapify(heap)
    return heap


def pack_best_fit(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Best-fit decreasing: each piece goes to the fullest sequence that still holds it."""
    tree, out = CapacityTree(capacity), []
    for _, _, piece in sorted(descending(pieces)):
        found = tree.tightest(len(piece))
        if found is None:
            out.append([])
            found = (0, len(out) - 1, capacity)
        out[found[1]].append(piece)
        if room := found[2] - len(piece):
            tree.add(room, 0, found[1])
    return out


def piece_cost(n: int, linear: float, quadratic: float) -> float:
    return linear * n + quadratic * n * n


def pack_cost_balanced(
    pieces: list[Piece], capacity: int, linear: float, quadratic: float
) -> list[list[Piece]]:
    """As few sequences as hold all ids; pieces by descending cost go to the cheapest with room.

    A piece that no sequence can hold whole fills the roomiest one; its rest takes its place in the
    order again, so padding is below one sequence for the whole list.
    """
    count = -(-sum(map(len, pieces)) // capacity)
    tree, out = CapacityTree(capacity), [[] for _ in range(count)]
    for i in range(count):
        tree.add(capacity, 0.0, i)
    heap, order = descending(pieces), len(pieces)
    while heap:
        _, _, piece = heapq.heappop(heap)
        found = tree.cheapest(len(piece))
        if found is None:
            found = tree.roomiest()
            piece, rest = piece.split(found[2])
            heapq.heappush(heap, (-len(rest), order, rest))
            order += 1
        cost, at, room = found
        out[at].append(piece)
        if room := room - len(piece):
            tree.add(room, cost + piece_cost(len(piece), linear, quadratic), at)
    return out


def sequences(
    batches, path: str, end_id: int, capacity: int, block_tokens: int, pack: Callable
) -> Iterator[list[Piece]]:
    """Tokenise rows (key, text) and pack them block by block."""
    encode, waiting, held = encoder(path).encode, [], 0
    close = int(end_id).to_bytes(4, "little")
    for batch in batches:
        for key, text in zip(*columns(batch, "key", "text"), strict=True):
            ids = memoryview(encode(text or "") + close)
            piece = Piece(key, 0, ids, len(ids) // 4)
            while len(piece) > capacity:  # overlong: whole sequences first, the rest is packed
                full, piece = piece.split(capacity)
                yield [full]
            waiting.append(piece)
            held += len(piece)
            if held >= block_tokens:
                yield from pack(waiting, capacity)
                waiting, held = [], 0
    yield from pack(waiting, capacity)


def _sequence_ids() -> Iterator[int]:
    """Unique numbers: the task's partition in the high bits, a count in the low ones."""
    number = TaskContext.get().partitionId() << 36
    while True:
        yield number
        number += 1


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))


def cost_balanced_pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per piece: where it comes from and where it lies.

    Cost of a piece of n ids is ``linear * n + quadratic * n * n``: attention stays within a piece.
    Columns: the key (null stays null), start, length, ids_crc32, doc_tokens, sequence_id, offset.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    names = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        schema, rows, number = None, [], _sequence_ids()
        key_type = None

        def seen(batches):
            nonlocal key_type
            for b in batches:
                key_type = b.schema.field("key").type
                yield b

        pack = lambda waiting, n: pack_cost_balanced(waiting, n, linear, quadratic)
        for sequence in sequences(seen(batches), vocabulary, end_id, capacity, block_tokens, pack):
            if schema is None:
                longs = [(c.split()[0], pa.int64()) for c in names.split(", ")]
                schema = pa.schema([("key", key_type), *longs])
            at, offset = next(number), 0
            for p in sequence:
                rows.append((p.key, p.start, len(p), zlib.crc32(p.ids), p.total, at, offset))
                offset += len(p)
            if len(rows) >= 10_000:
                yield from emit(rows, schema)
                rows = []
        yield from emit(rows, schema)

    out = _rows(docs, key, text).mapInArrow(run, f"key {kind.simpleString()}, {names}")
    assert spark is out.sparkSession
    return out.withColumnRenamed("key", key)


_MATRIX = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("keys", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("input_ids", pa.binary()),
        ("position_ids", pa.binary()),
        ("ids_crc32", pa.int64()),
    ]
)


def packed_matrices(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    pad_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """Best-fit-decreasing packing, one row per sequence: a row of the id matrix and its layout.

    ``input_ids`` has ``capacity`` little-endian unsigned 32-bit ids, padded with ``pad_id``;
    ``cu_seqlens`` runs from 0 over the ends of the segments to ``n_tokens``; ``position_resets`` are
    the offsets at which positions start anew; ``position_ids`` has ``capacity`` little-endian
    unsigned 16-bit positions that count from 0 within each segment, 0 in the padding. ``keys`` and
    ``starts`` say which document, and which part of it, a segment is. ``ids_crc32`` is over the ids
    without padding. Documents over ``capacity`` are cut into whole sequences and a rest. The key is an
    integer; null stays null. An empty table gives no rows.
    """
    if not 0 < capacity <= 65_536:
        raise ValueError("capacity must fit 16-bit positions")

    def run(batches):
        rows, number = [], _sequence_ids()
        pad = int(pad_id).to_bytes(4, "little")
        for sequence in sequences(batches, vocabulary, end_id, capacity, block_tokens, pack_best_fit):
            lengths = np.array([len(p) for p in sequence])
            ends = np.concatenate([[0], np.cumsum(lengths)])
            n = int(ends[-1])
            ids = b"".join(p.ids for p in sequence)
            places = np.zeros(capacity, "<u2")
            places[:n] = np.arange(n) - np.repeat(ends[:-1], lengths)
            rows.append(
                (
                    next(number),
                    n,
                    [p.key for p in sequence],
                    [p.start for p in sequence],
                    ends.tolist(),
                    ends[:-1].tolist(),
                    ids + pad * (capacity - n),
                    places.tobytes(),
                    zlib.crc32(ids),
                )
            )
            if len(rows) >= 1_000:
                yield from emit(rows, _MATRIX)
                rows = []
        yield from emit(rows, _MATRIX)

    return (
        docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
        .mapInArrow(
            run,
            "sequence_id long, n_tokens int, keys array<long>, starts array<long>, cu_seqlens array<int>,"
            " position_resets array<int>, input_ids binary, position_ids binary, ids_crc32 long",
        )
    )


def unpack(row_ids: bytes, cu_seqlens: list[int]) -> list[np.ndarray]:
    """The segments of a packed row, as arrays of ids."""
    ids = np.frombuffer(row_ids, _ID)
    return [ids[a:b] for a, b in zip(cu_seqlens, cu_seqlens[1:])]
