"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of the hashes of the text's word shingles have it. Two
fingerprints that differ in at most three bits agree up to one bit in one of their two halves. Each half
of each distinct fingerprint is a table entry; the values within one bit of a half are its probes. What
a probe meets is verified over all bits, and verified links are closed to components.

Copies have one fingerprint and are one node, so a group of copies costs one entry however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns, emit, set_aside, stored
from tidemark.llm.components import components

SEED = 42
_SLICE = 1 << 16  # hashes counted at once


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint; letters A-Z count as lower case, words are parted by ASCII blanks.

    A text with fewer words than a shingle is one shingle; without words the fingerprint is 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest, seed = b" ".join(words), xxhash.xxh64_intdigest, SEED
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = np.array(hashes[at : at + _SLICE], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key``, ``th`` (hash of the text) and ``fp``, the fingerprint as a signed 64-bit integer, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = (batch.column(batch.schema.get_field_index(c)) for c in ("key", "th"))
            (texts,) = columns(batch, "text")
            fps = np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([keys, hashes, pa.array(fps)], names=["key", "th", "fp"])

    rows = docs.select(
        docs[key].alias("key"), F.xxhash64(docs[text]).alias("th"), docs[text].cast("string").alias("text")
    )
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, th long, fp long")


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints ``fp`` that differ in 1 to ``distance`` <= 3 bits."""
    if not 0 < distance <= 3:
        raise ValueError("two halves within one bit cover distances up to 3")
    halves = F.array(
        F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", 32).alias("value")),
        F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)).alias("value")),
    )
    entries = nodes.select("fp", F.inline(halves))
    flips = F.lit([0, *[1 << i for i in range(32)]]).cast("array<bigint>")
    probes = entries.select(
        F.col("fp").alias("other"), "part", F.explode(flips).alias("flip"), F.col("value").alias("own")
    ).select("other", F.col("part").alias("p"), F.col("own").bitwiseXOR(F.col("flip")).alias("v"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    met = (F.col("part") == F.col("p")) & (F.col("value") == F.col("v")) & (F.col("other") < F.col("fp"))
    # The probes are many times the size of what they come from; never broadcast them.
    return entries.hint("merge").join(probes, met & near).select(F.col("other").alias("a"), F.col("fp").alias("b"))


def _groups(docs: DataFrame, key: str, text: str, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and the ``root`` of each fingerprint's component."""
    rows = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), distance))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    return rows, stored(placed, "placed")


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the least key reachable over links.

    One row per row of ``docs``; a null key is never the least unless a group has no other. Null, empty
    and blank texts have fingerprint zero and are linked like any other. Other columns are ignored; an
    empty table gives no rows.
    """
    rows, placed = _groups(docs, key, text, shingle, distance)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """The rows, with all their columns, of one document of each group of near-duplicates.

    It is the one with the least key, null last; of rows with one key the text's hash decides, and of
    rows with one key and text one stays.
    """
    docs, (key, text), named_back = set_aside(docs, "sh_", key, text)
    rows, placed = _groups(docs, key, text, shingle, distance)
    here = F.struct(F.col("key").isNull(), "key", "th")
    of_print = rows.groupBy("fp").agg(F.min(here).alias("k")).join(placed, "fp")  # copies fold first
    kept = of_print.groupBy("root").agg(F.min("k").alias("k"))
    # Structs compare nulls as equal, and one column serves the join and the window: one exchange.
    kind = f"struct<key:{docs.schema[key].dataType.simpleString()},th:bigint>"
    kept = kept.select(F.struct("k.key", "k.th").cast(kind).alias("sh_id"))
    named = docs.withColumn("sh_id", F.struct(F.col(key), F.xxhash64(text)).cast(kind))
    copies = Window.partitionBy("sh_id").orderBy(F.lit(0))
    out = named.join(kept.hint("merge"), "sh_id").withColumn("sh_at", F.row_number().over(copies))
    return named_back(out.where("sh_at = 1").select(*docs.columns))
