"""Vector code compression by dual-tree Lloyd rounds.

Components become integers, vectors are cut into consecutive parts, and each part position has a codebook
that Lloyd rounds improve. A block of vectors has a tree per part, built once and stored with the box, the
sum and the number of its vectors at each node; a codebook has a tree of its entries. In a round both are
descended together, level by level. The least and greatest distances between the boxes of two nodes say
which entry nodes can't hold the nearest entry of any vector in the node; a single entry also goes where
another one is nearer over the whole box. A node with one entry left is assigned as a whole, by its
stored sum. In leaves that stay uncertain, distances to the entries left are computed vector by vector.
Everything is integer arithmetic, so a round gives what comparing all pairs would give.

A round sends sums per part, entry and place to the driver, as many as the codebooks have components,
whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns, emit, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
_LEAF = 16  # vectors of a leaf, at least
_BLOCK = 1 << 18  # components of a block


class Tree:
    """Points in an order in which the nodes of each level are consecutive, with the nodes' boxes.

    Level d has 2^d nodes; the bounds of node k are k * n >> d and (k + 1) * n >> d. Each level splits the
    nodes of the one above at the median of their widest side.
    """

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        self.n = len(points)
        self.depth = max(0, (self.n // leaf).bit_length() - 1)
        self.order = self._sorted(points) if order is None else order
        self.points = points[self.order]
        self.low, self.high = self._boxes(self.points)

    def bounds(self, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1, dtype=np.int64) * self.n >> level

    def _sorted(self, points: np.ndarray) -> np.ndarray:
        order = np.arange(self.n)
        for level in range(self.depth):
            now, cuts = points[order], self.bounds(level)
            wide = np.maximum.reduceat(now, cuts[:-1]) - np.minimum.reduceat(now, cuts[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(cuts))
            order = order[np.lexsort((now[np.arange(self.n), wide.argmax(axis=1)[node]], node))]
        return order

    def _boxes(self, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        leaves = self.bounds(self.depth)[:-1]
        low, high = [np.minimum.reduceat(points, leaves)], [np.maximum.reduceat(points, leaves)]
        for _ in range(self.depth):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        return low, high

    def sums(self) -> list[np.ndarray]:
        """Sums of the points of each node, by level."""
        out = [np.add.reduceat(self.points, self.bounds(self.depth)[:-1])]
        for _ in range(self.depth):
            out.insert(0, out[0][::2] + out[0][1::2])
        return out


class Book(Tree):
    """The tree of a codebook's entries; below its nodes, the entries themselves are one more level."""

    def __init__(self, entries: np.ndarray):
        super().__init__(entries, 1)
        self.low.append(self.points)
        self.high.append(self.points)
        self.norms = (self.points * self.points).sum(axis=1)

    def below(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes' places in the next level: first one and number."""
        if level < self.depth:
            return 2 * nodes, np.full(len(nodes), 2)
        cuts = self.bounds(level)
        return cuts[nodes], cuts[nodes + 1] - cuts[nodes]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive numbers from each ``first``, as many as ``count``, and whose they are."""
    owner = np.repeat(np.arange(len(first)), count)
    return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def _starts(sorted_ids: np.ndarray) -> np.ndarray:
    return np.nonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])[0]


def _least(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of each stretch, given for each of its items."""
    return np.repeat(np.minimum.reduceat(values, starts), np.diff(np.r_[starts, len(values)]))


def _not_beaten(tree: Tree, book: Book, level: int, point: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Entries that may be nearest to some place of the box, against the one nearest to its centre."""
    low, high, at = tree.low[level][point], tree.high[level][point], book.points[entry]
    middle = ((2 * at - low - high) ** 2).sum(axis=1)
    starts = _starts(point)
    first = np.where(middle == _least(middle, starts), np.arange(len(point)), len(point))
    best = entry[_least(first, starts)]
    apart = at - book.points[best]
    corner = np.where(apart > 0, high, low)
    # How much nearer the entry is than the best one, at the corner that suits it most.
    lead = book.norms[best] - book.norms[entry] + 2 * (corner * apart).sum(axis=1)
    return (lead > 0) | (lead == 0) & (book.order[entry] <= book.order[best])


def nearest(tree: Tree, book: Book) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """Per level, nodes that are assigned as a whole and their entries; and the entry of each point in order."""
    point = entry = np.zeros(1, np.int64)
    level = depth = 0
    whole, labels = [], np.full(tree.n, -1)
    while len(point):
        low, high = tree.low[level][point], tree.high[level][point]
        e_low, e_high = book.low[depth][entry], book.high[depth][entry]
        near = np.maximum(0, np.maximum(e_low - high, low - e_high))
        far = np.maximum(np.abs(high - e_low), np.abs(e_high - low))
        keep = (near * near).sum(axis=1) <= _least((far * far).sum(axis=1), _starts(point))
        point, entry = point[keep], entry[keep]
        if depth > book.depth:
            keep = _not_beaten(tree, book, level, point, entry)
            point, entry = point[keep], entry[keep]
            starts = _starts(point)
            alone = np.repeat(np.diff(np.r_[starts, len(point)]) == 1, np.diff(np.r_[starts, len(point)]))
            nodes, own = point[alone], book.order[entry[alone]]
            whole.append((level, nodes, own))
            cuts = tree.bounds(level)
            at, owner = _spread(cuts[nodes], cuts[nodes + 1] - cuts[nodes])
            labels[at] = own[owner]
            point, entry = point[~alone], entry[~alone]
            if level == tree.depth:
                break
        else:
            first, count = book.below(entry, depth)
            entry, owner = _spread(first, count)
            point, depth = point[owner], depth + 1
        if level < tree.depth:
            point, entry = np.concatenate([2 * point, 2 * point + 1]), np.concatenate([entry, entry])
            order = np.argsort(point, kind="stable")
            point, entry, level = point[order], entry[order], level + 1
    _settle(tree, book, point, entry, labels)
    return whole, labels


def _settle(tree: Tree, book: Book, leaf: np.ndarray, entry: np.ndarray, labels: np.ndarray) -> None:
    """Distances of all points of uncertain leaves to the entries left there, ties to the lower index."""
    cuts = tree.bounds(tree.depth)
    for rows in np.split(np.arange(len(leaf)), _starts(leaf)[1:]) if len(leaf) else ():
        left = entry[rows][np.argsort(book.order[entry[rows]])]
        here = slice(cuts[leaf[rows[0]]], cuts[leaf[rows[0]] + 1])
        # The distance less the point's own norm, which is the same for all entries.
        gap = book.norms[left] - 2 * (tree.points[here] @ book.points[left].T)
        labels[here] = book.order[left][gap.argmin(axis=1)]


_PART = pa.struct([("values", pa.binary()), ("order", pa.binary()), ("sums", pa.binary()), ("kind", pa.string())])
_PART_DDL = "struct<values:binary,order:binary,sums:binary,kind:string>"


def _planted(points: np.ndarray) -> dict:
    """A part's tree as bytes: points and boxes follow from the order, sums are kept."""
    tree = Tree(points, _LEAF)
    kind = next(k for k in ("<i2", "<i4", "<i8") if abs(points).max() <= np.iinfo(k).max)
    sums = np.concatenate(tree.sums()) if tree.depth else tree.sums()[0]
    return {
        "values": points.astype(kind).tobytes(),
        "order": tree.order.astype("<i4").tobytes(),
        "sums": sums.astype("<i8").tobytes(),
        "kind": kind,
    }


def _grown(part: dict, width: int) -> tuple[Tree, np.ndarray]:
    points = np.frombuffer(part["values"], part["kind"]).astype(np.int64).reshape(-1, width)
    tree = Tree(points, _LEAF, np.frombuffer(part["order"], "<i4"))
    return tree, np.frombuffer(part["sums"], "<i8").reshape(-1, width)


def _blocks(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Vectors of a task in blocks, with their keys and labels and a tree per part."""
    width = -(-length // parts)
    size = max(_LEAF, _BLOCK // (width * parts))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points = np.zeros((len(table), width * parts), np.int64)
        points[:, :length] = values.reshape(-1, length)
        trees = [_planted(points[:, p * width : (p + 1) * width]) for p in range(parts)]
        who = pa.StructArray.from_arrays(
            [table.column(c).combine_chunks() for c in ("id", "label")], names=["id", "label"]
        )
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), who), pa.array([trees], pa.list_(_PART))],
            names=["who", "parts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                piece = batch.slice(at, min(len(batch) - at, size - n))
                held.append(piece)
                at, n = at + len(piece), n + len(piece)
                if n == size:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return rows.mapInArrow(
        run, f"who array<struct<id:{kinds[0]},label:{kinds[1]}>>, parts array<{_PART_DDL}>"
    )


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _improved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: entries become the floored means of their parts."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Book(b) for b in books]
        totals = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
                for p, part in enumerate(parts):
                    tree, sums = _grown(part, width)
                    whole, labels = nearest(tree, trees[p])
                    counts[p] += np.bincount(labels, minlength=len(books[p]))
                    single = np.ones(tree.n, bool)
                    for level, nodes, entries in whole:
                        np.add.at(totals[p], entries, sums[(1 << level) - 1 + nodes])
                        cuts = tree.bounds(level)
                        single[_spread(cuts[nodes], cuts[nodes + 1] - cuts[nodes])[0]] = False
                    np.add.at(totals[p], labels[single], tree.points[single])
        for p, n in enumerate(counts):
            used = np.nonzero(n)[0]
            yield from emit([(p, int(e), int(n[e]), totals[p][e].tolist()) for e in used], _SUMS)

    sums = blocks.select("parts").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    sums = sums.groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    )
    out = [b.copy() for b in books]
    for row in sums.collect():  # at most one row per component of the codebooks
        out[row["part"]][row["entry"], row["at"]] = int(row["x"]) // row["n"]
    return out


def _coded(blocks: DataFrame, books: list[np.ndarray], ddl: str) -> DataFrame:
    """Key, label, code and error of each vector."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Book(b) for b in books]
        for batch in batches:
            for who, parts in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("who", "parts"))):
                ids = who.values
                codes = np.zeros((len(ids), len(books)), np.uint8)
                errors = np.zeros(len(ids), np.int64)
                for p, part in enumerate(parts.as_py()):
                    tree, _ = _grown(part, width)
                    labels = nearest(tree, trees[p])[1]
                    gap = tree.points - books[p][labels]
                    codes[tree.order, p] = labels
                    errors[tree.order] += (gap * gap).sum(axis=1)
                hexed = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays(
                    [ids.field("id"), ids.field("label"), pa.array(hexed), pa.array(errors)],
                    names=["id", "label", "code", "error"],
                )

    return blocks.mapInArrow(run, ddl)


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """``key``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``, one row per vector kept.

    Components become floor(``scale`` * x). Each codebook starts as the parts of the ``entries`` <= 256
    smallest keys (null last, equal keys by their vectors). A code has two hex digits per part; the error is
    the squared distance to the coded entries, ``label_error`` its sum over all rows of an equal label, nulls
    together; the digest is that of all final components, comma-joined.

    Vectors that are null, empty or hold a null or non-finite component are left out, and so are those
    that differ in length from the one of the smallest key. Parts of a length that ``parts`` doesn't divide
    are filled up with zeros. Repeated rows count as often as they occur. Vectors so large that a squared
    distance may not fit in 62 bits raise a ValueError. Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part")
    finite = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        vectors[key].alias("id"), vectors[label].alias("label"), vectors[vector].cast("array<double>").alias("x")
    ).where(F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    order = [F.col("id").asc_nulls_last(), F.col("x").asc()]
    first = rows.orderBy(*order).limit(1).collect()
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    if not first:
        return _named(rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), key, "")
    length = len(first[0]["x"])
    rows = rows.where(F.size("x") == length)
    largest = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    if length * (2 * (scale * largest + 1)) ** 2 >= float(1 << 62):
        raise ValueError("squared distances may not fit in 62 bits")
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))))
    start = rows.orderBy(*order).limit(entries).select(whole.alias("v")).collect()  # bounded by ``entries``
    width = -(-length // parts)
    points = np.zeros((len(start), width * parts), np.int64)
    points[:, :length] = [r["v"] for r in start]
    books = [np.ascontiguousarray(points[:, p * width : (p + 1) * width]) for p in range(parts)]
    blocks = stored(_blocks(rows.select("id", "label", whole.alias("v")), length, parts), "blocks")
    for _ in range(rounds):
        books = _improved(blocks, books)
    told = ",".join(str(x) for b in books for x in b.ravel().tolist())
    coded = stored(_coded(blocks, books, f"id {kinds[0]}, label {kinds[1]}, code string, error long"), "coded")
    return _named(coded, key, hashlib.sha256(told.encode()).hexdigest())


def _named(coded: DataFrame, key: str, digest: str) -> DataFrame:
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
