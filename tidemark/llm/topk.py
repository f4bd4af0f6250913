"""Exact top-k by integer inner product with distributed histogram selection.

All scores of the queries are computed in blocks, several times: each pass counts them per query in a
histogram over the interval that still holds the k-th highest score, and the next interval is the bin
in which it lies. When every interval is one score wide, a last pass keeps the scores above it and, of
those equal to it, as many of the smallest keys as are still wanted. Scores are never stored.

Vectors meet by shuffles only: stored blocks and states take far less room than what they hold, so a join that went by
the size of their files would send all of it through the driver.

A vector that is null, empty, or holds a null or non-finite component takes no part, nor does a vector
with a null key. Scores are defined between vectors of one length and must fit 62 bits. Repeated rows
count as often as they occur, as queries and as candidates; rows with the query's own key are no
candidates. Ties go to the smaller key. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns, emit, forget, partitions, stored

_BINS = 512
_QUERY_BLOCK = 512  # queries scored together
_ROW_BLOCK = 4096  # candidates scored together
_EXACT = 1 << 52  # below this, sums of products are exact in doubles


def _blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """Vectors of one length packed into blocks: ids and values as bytes, rows in order within a task. Values
    take as many bytes as the largest of them needs."""
    schema = pa.schema(
        [("dim", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("largest", pa.float64())]
    )

    def pack(dim: int, part: list[tuple]) -> tuple:
        values = np.array([v for _, v in part], "<i8")
        norms = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(values).max() <= np.iinfo(k).max)
        return dim, np.array([i for i, _ in part], "<i8").tobytes(), values.astype(kind).tobytes(), float(norms.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list[tuple]] = {}
        held = 0
        for batch in batches:
            done = []
            for i, v in zip(*columns(batch, "id", "v"), strict=True):
                part = open_blocks.setdefault(len(v), [])
                part.append((i, v))
                held += 1
                if len(part) >= per_block:
                    done.append(pack(len(v), open_blocks.pop(len(v))))
                    held -= per_block
            if held > 4 * per_block:  # many lengths at once
                done += [pack(d, p) for d, p in open_blocks.items()]
                open_blocks, held = {}, 0
            yield from emit(done, schema)
        yield from emit([pack(d, p) for d, p in open_blocks.items()], schema)

    return rows.mapInArrow(run, "dim int, ids binary, values binary, largest double")


def _matrix(values: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(values, f"<i{len(values) // (n * dim)}").reshape(n, dim).astype(np.int64)


def _scores(queries: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    """Inner products, exact: in doubles while sums are small enough, else in 64-bit integers."""
    if bound < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


class _Pair:
    """A block of queries against a block of candidates."""

    def __init__(self, dim, q_ids, q_values, q_largest, ids, values, largest):
        self.q_ids, self.ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
        self.scores = _scores(
            _matrix(q_values, len(self.q_ids), dim),
            _matrix(values, len(self.ids), dim),
            q_largest * largest,
        )
        self.other = self.q_ids[:, None] != self.ids[None, :]


_PAIR = ("dim", "q_ids", "q_values", "q_largest", "ids", "values", "largest")


def _pairs(batches, *more: str):
    for batch in batches:
        for row in zip(*columns(batch, *_PAIR, *more), strict=True):
            yield _Pair(*row[: len(_PAIR)]), row[len(_PAIR) :]


def _histograms(pairs: DataFrame, span: int, width: int) -> DataFrame:
    """Counts of scores per query and bin of its interval, from ``low`` on over ``span`` scores."""
    schema = pa.schema([("q_block", pa.int64()), ("at", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def flush(counted: dict) -> Iterator[pa.RecordBatch]:
        for block, counts in counted.items():
            q, b = np.nonzero(counts)
            if len(q):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(q), block)),
                        pa.array(q.astype(np.int32)),
                        pa.array(b.astype(np.int32)),
                        pa.array(counts[q, b]),
                    ],
                    schema=schema,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, np.ndarray] = {}
        for pair, (block, low) in _pairs(batches, "q_block", "low"):
            if block not in counted:
                if len(counted) >= 16:
                    yield from flush(counted)
                    counted = {}
                counted[block] = np.zeros((len(pair.q_ids), _BINS), np.int64)
            low = np.array(low, np.int64)[:, None]
            bins = (pair.scores - low) // width
            inside = pair.other & (pair.scores >= low) & (pair.scores < low + span)
            cell = bins + np.arange(len(low))[:, None] * _BINS
            counted[block] += np.bincount(cell[inside], minlength=len(low) * _BINS).reshape(-1, _BINS)
        yield from flush(counted)

    counts = pairs.mapInArrow(run, "q_block long, at int, bin int, n long")
    return counts.groupBy("q_block", "at", "bin").agg(F.sum("n").alias("n"))


def _kept(pairs: DataFrame) -> DataFrame:
    """Scores above the k-th and, per pair of blocks, the smallest keys of those equal to it."""
    schema = pa.schema([(c, pa.int64()) for c in ("q_block", "at", "query_id", "vec_id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, (block, kth, wanted) in _pairs(batches, "q_block", "kth", "wanted"):
            kth = np.array(kth, np.int64)[:, None]
            q, c = np.nonzero(pair.other & (pair.scores > kth))
            qs, cs = [q], [c]
            order = np.argsort(pair.ids, kind="stable")
            ties = (pair.other & (pair.scores == kth))[:, order]
            for i in np.nonzero(ties.any(axis=1))[0]:
                first = order[np.nonzero(ties[i])[0][: wanted[i]]]
                qs.append(np.full(len(first), i))
                cs.append(first)
            q, c = np.concatenate(qs), np.concatenate(cs)
            if len(q):
                found = (np.full(len(q), block), q, pair.q_ids[q], pair.ids[c], pair.scores[q, c])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    return pairs.mapInArrow(run, "q_block long, at long, query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: each query's k highest scores.

    Components are scaled to integers, floor(scale * x). ``is_query`` is a condition on the key column
    ``id`` that says which rows are queries; all rows are candidates.
    """
    rows = vectors.select(
        vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("x")
    )
    top = float(1 << 62)
    whole = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < F.lit(top / scale)))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & whole)
    rows = rows.select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    lanes = partitions(vectors.sparkSession)
    queries = _blocks(rows.where(is_query), _QUERY_BLOCK).toDF("q_dim", "q_ids", "q_values", "q_largest")
    queries = stored(queries.withColumn("q_block", F.monotonically_increasing_id()), "queries")
    blocks = _blocks(rows, _ROW_BLOCK).withColumn("lane", F.monotonically_increasing_id() % lanes)
    blocks = stored(blocks, "blocks")
    dealt = blocks.repartition(lanes, "dim", "lane")  # as many tasks as lanes, however little they read
    largest = blocks.agg(F.max("largest")).first()[0]
    if largest is None:
        return blocks.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def against(state: DataFrame, *names: str) -> DataFrame:
        """The stated query blocks, with their queries' state as arrays, against all candidate blocks.

        Each lane of candidate blocks gets a copy of the query blocks.
        """
        listed = F.sort_array(F.collect_list(F.struct("at", *names)))  # one entry per query of a block
        packed = state.groupBy("q_block").agg(listed.alias("s"))
        packed = packed.select("q_block", *[F.col(f"s.{n}").alias(n) for n in names])
        copies = queries.join(packed.hint("merge"), "q_block")
        copies = copies.withColumn("q_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<long>")))
        copies = copies.repartition(lanes, "q_dim", "q_lane").hint("merge")
        return dealt.join(copies, (F.col("dim") == F.col("q_dim")) & (F.col("lane") == F.col("q_lane")))

    bound = min((int(largest) + 1) ** 2, (1 << 61) - 1)
    span = 2 * bound + 1
    width = -(-span // _BINS)
    state = queries.mapInArrow(_places, "q_block long, at int")
    state = state.withColumn("low", F.lit(-bound).cast("long")).withColumn("wanted", F.lit(k).cast("long"))
    state = stored(state, "state")
    while True:
        counts = _histograms(against(state, "low"), span, width)
        downwards = Window.partitionBy("q_block", "at").orderBy(F.desc("bin"))  # as many rows as bins
        counts = counts.withColumn("upto", F.sum("n").over(downwards)).join(
            state.select("q_block", "at", "wanted").hint("merge"), ["q_block", "at"]
        )
        # The bin in which the wanted score lies; with fewer scores than wanted, the lowest one.
        enough = F.when(F.col("upto") >= F.col("wanted"), F.struct("bin", "upto", "n"))
        hit = counts.groupBy("q_block", "at").agg(
            F.coalesce(F.max(enough), F.min(F.struct("bin", "upto", "n"))).alias("h")
        )
        above = F.coalesce(F.col("h.upto") - F.col("h.n"), F.lit(0))
        moved = stored(
            state.join(hit.hint("merge"), ["q_block", "at"], "left").select(
                "q_block",
                "at",
                (F.col("low") + F.coalesce("h.bin", F.lit(0)) * F.lit(width).cast("long")).alias("low"),
                F.greatest(F.lit(1), F.col("wanted") - above).cast("long").alias("wanted"),
            ),
            "state",
        )
        forget(state)
        state = moved
        if width == 1:
            break
        span, width = width, -(-width // _BINS)
    best = _kept(against(state.withColumnRenamed("low", "kth"), "kth", "wanted"))
    order = Window.partitionBy("q_block", "at").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block and place of every query."""
    for batch in batches:
        for block, ids in zip(*columns(batch, "q_block", "q_ids"), strict=True):
            n = len(ids) // 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32))], names=["q_block", "at"]
            )
