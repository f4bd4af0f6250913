"""Lempel-Ziv phrase fingerprints, and likeness of documents to an edited text and to the next document.

A text is parsed into the phrases of a growing dictionary (each phrase is the shortest run of code
points not seen before); the phrase set is hashed and the smallest hashes are its signature. Two
signatures give an estimate of the phrase sets' Jaccard likeness, as in compression distances.

A null text counts as empty; an empty text has an empty signature, like only to other empty ones. Texts
of any length are parsed whole. Rows with one key follow each other by text; rows with a null key come
first. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns, emit, partitions

SIGNATURE = 128  # smallest hashes kept
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 18  # code points hashed at once


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 4096), _powers(_INVERSE, 4096)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)
    return _UP, _DOWN


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32)


def walk(text: str, seen: set[str], phrase: str = "") -> tuple[list[int], str]:
    """Parse on from an open phrase: ends of the new phrases in ``text``, and the open rest."""
    ends: list[int] = []
    add, close, at = seen.add, ends.append, 0
    for c in text:
        at += 1
        phrase += c
        if phrase not in seen:
            add(phrase)
            close(at)
            phrase = ""
    return ends, phrase


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases that end at the given places; the first starts at 0.

    A phrase's hash is a polynomial in its code points, taken from running sums over the text.
    """
    stops = np.array(ends, np.int64)
    out, first = [], 0
    while first < len(stops):
        begin = int(stops[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(stops, begin + _CHUNK)))
        part = text[begin : int(stops[last - 1])]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        up, down = _power_tables(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
        stop = stops[first:last] - begin
        start = np.concatenate([[0], stop[:-1]])
        out.append(_mixed((sums[stop] - sums[start]) * down[start]))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def smallest(hashes: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    if len(hashes) > 8 * size:
        hashes = np.partition(hashes, 4 * size)[: 4 * size] if _few_repeats(hashes, size) else hashes
    return np.unique(hashes)[:size]


def _few_repeats(hashes: np.ndarray, size: int) -> bool:
    """Whether the lowest part surely holds enough distinct hashes. Phrases of a text are distinct, so
    only chance makes hashes equal."""
    return len(np.unique(np.partition(hashes, 4 * size)[: 4 * size])) >= size


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    """Share of common hashes among the smallest of both."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def signature(text: str, size: int = SIGNATURE) -> np.ndarray:
    return smallest(phrase_hashes(text, walk(text, set())[0]), size)


def written_out(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


class _Parsed:
    """A document with what parsing its edited text needs: the state after the part that stays."""

    def __init__(self, key, text: str, size: int):
        self.key, self.text = key, text
        self.kept = len(text) - len(text) // 2
        self.seen: set[str] = set()
        head = text[: self.kept]
        ends, self.phrase = walk(head, self.seen)
        self.head = phrase_hashes(head, ends)
        self.tail_from = ends[-1] if ends else 0
        self.sig = self._signature(text[self.kept :], set(self.seen), size)

    def _signature(self, tail: str, seen: set[str], size: int) -> np.ndarray:
        ends, _ = walk(tail, seen, self.phrase)
        rest = self.text[self.tail_from : self.kept]  # the phrase that was open
        hashes = phrase_hashes(rest + tail, [e + len(rest) for e in ends])
        return smallest(np.concatenate([self.head, hashes]), size)

    def row(self, following: _Parsed, size: int) -> tuple:
        tail = following.text[: len(self.text) // 2]
        edited = self._signature(tail, self.seen, size)
        return (
            self.key,
            len(self.text),
            hashlib.sha256((self.text[: self.kept] + tail).encode()).hexdigest(),
            written_out(self.sig),
            written_out(edited),
            likeness(self.sig, edited, size),
            likeness(self.sig, following.sig, size),
        )


def buckets(docs: DataFrame, key: str, count: int) -> Bucketizer:
    """Gives ``_bucket``, the key range that ``_key`` lies in; the ranges hold about as many rows each."""
    at = [i / count for i in range(1, count)]
    bounds = docs.agg(F.percentile_approx(key, at, 10_000)).first()[0] if at else None
    bounds = sorted({float(x) for x in bounds or [0]})
    splits = [-float("inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket", handleInvalid="keep")


def fingerprint_chain(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIGNATURE) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next one.

    The edited text has its last half (rounded down) replaced by as many code points from the start of
    the next document by ascending key; after the last comes the first. Keys are numbers.

    Rows are dealt into ranges of keys and parsed in order, one document at a time; whole texts are
    shuffled once. The first document of a range is sent to the range before it as well: one row per
    range, and there are as many ranges as shuffle partitions.
    """
    count = partitions(docs.sparkSession)
    rows = docs.select(
        docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")
    )
    model = buckets(rows, "key", count)
    rows = model.transform(rows.withColumn("_key", F.col("key").cast("double")))
    rows = rows.withColumn("_bucket", F.when(F.col("key").isNull(), -1).otherwise(F.col("_bucket").cast("int")))
    keys = docs.select(docs[key].alias("key"), docs[key].cast("double").alias("_key"))
    keys = model.transform(keys).withColumn(
        "_bucket", F.when(F.col("key").isNull(), -1).otherwise(F.col("_bucket").cast("int"))
    )
    heads = keys.groupBy("_bucket").agg(F.min("key").alias("head"))
    ordered = Window.orderBy("_bucket")  # one row per range
    last = F.max("_bucket").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("head", F.coalesce(F.lag("_bucket").over(ordered), last).alias("before"))
    places = F.array(
        F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("f")),
        F.struct(F.col("before").alias("b"), F.lit(1).alias("f")),
    )
    dealt = (
        rows.join(F.broadcast(heads), rows["key"].eqNullSafe(heads["head"]), "left")
        .withColumn("place", F.explode(F.when(F.col("before").isNull(), F.slice(places, 1, 1)).otherwise(places)))
        .select("key", "text", F.col("place.b").alias("bucket"), F.col("place.f").alias("follows"))
        .repartition(count, "bucket")
        .sortWithinPartitions("bucket", "follows", "key", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, before, range_of = None, None, None
        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    [("key", batch.schema.field("key").type), ("n_chars", pa.int64())]
                    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
                    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
                )
            out = []
            for k, value, bucket, follows in zip(*columns(batch, "key", "text", "bucket", "follows"), strict=True):
                if follows and before is None:
                    continue
                here = _Parsed(k, value, size)
                if before is not None:
                    assert bucket == range_of
                    out.append(before.row(here, size))
                before, range_of = (None if follows else here), bucket
            yield from emit(out, schema)

    kind = docs.schema[key].dataType.simpleString()
    return dealt.mapInArrow(
        run,
        f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    ).withColumnRenamed("key", key)
