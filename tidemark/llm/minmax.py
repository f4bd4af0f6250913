"""MinHash near-duplicates by min-max hashing.

Every distinct word shingle of a text has one 64-bit hash. A permutation of these keeps both its least and
its greatest value, so 64 evaluations a shingle give a signature of 128 values, each equal in two texts with
a chance of their Jaccard likeness. Four values of different permutations form a band; the 32 bands of
likeness 0.8 all differ with a chance of 5e-8. Texts that share a band are candidates, and a link is
confirmed on the full sets.

Texts with one set are one node, so copies cost nothing. A bucket (nodes that share a band) is worked off in
two steps, each in units of bounded size that are dealt over all tasks:

1. All nodes of a bucket meet its least node, in blocks; what links is closed to components. This takes
   groups of near copies in a number of steps linear in their size.
2. Where nodes of different components are left in a bucket, its blocks meet each other. Within a unit the
   signatures say which nodes have a partner at all (in another component, of fitting size, in no earlier
   band, with enough equal values); only the sets of these are fetched and intersected, all at once. The
   pairs are never listed: a unit gives at most one link per node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns, emit, stored
from tidemark.llm.components import components

PERMUTATIONS = 64
BAND = 4  # signature values of a band
_UNIT = 1024  # nodes of a block, on average
_HELD = 1 << 21  # shingles of a block, on average
_SLICE = 1 << 13  # shingles hashed, or columns multiplied, together
_FREQUENT = 16  # shingles in more nodes of a unit are counted by a matrix product
_MEMO = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEED = 20240817


class _Hashes(dict):
    """64-bit hash of a word, remembered for the words of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


_HASHES = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of a text with fewer words, its whole sequence."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size = min(words, len(found))
    each = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    h = np.full(len(found) - size + 1 if size else 0, size, np.uint64)
    for j in range(size):
        h = h * _BASE + each[j : j + len(h)]
    return np.unique(_mixed(h))


def _keys(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(_SEED).integers(0, 1 << 63, (2, permutations), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def signature(hashes: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The least values under all permutations, then the greatest ones. ``hashes`` isn't empty."""
    factor, shift = _keys(permutations)
    low, high = np.full(permutations, (1 << 64) - 1, np.uint64), np.zeros(permutations, np.uint64)
    for at in range(0, len(hashes), _SLICE):
        values = hashes[at : at + _SLICE, None] * factor
        values = (values ^ (values >> np.uint64(29))) * (shift | np.uint64(1))
        low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    return np.concatenate([low, high])


def bands(values: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit hash per band, with its number."""
    grid = values[: len(values) // band * band].reshape(-1, band)
    h = np.arange(1, len(grid) + 1, dtype=np.uint64)
    for j in range(band):
        h = h * _BASE + grid[:, j]
    return _mixed(h)


def _printed(docs: DataFrame, words: int, permutations: int, band: int) -> DataFrame:
    """Per row: ``n``, the digest of its set, its bands and the low bytes of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = (batch.column(batch.schema.get_field_index(c)) for c in ("key", "th"))
            sizes, digests, listed, low = [], [], [], []
            for text in columns(batch, "text")[0]:
                found = shingles(text, words)
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), listed.append(None), low.append(None)
                    continue
                values = signature(found, permutations)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                listed.append(bands(values, band).view(np.int64))
                low.append(values.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    hashes,
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(listed, pa.list_(pa.int64())),
                    pa.array(low, pa.binary()),
                ],
                names=["key", "th", "n", "digest", "bands", "low"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, th long, n long, digest binary, bands array<bigint>, low binary")


_SET = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The full sets of the nodes, from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*columns(batch, "node", "text"), strict=True)
            yield from emit([(node, shingles(text, words).tobytes()) for node, text in rows], _SET)

    sought = nodes.select("node", F.col("of.key").alias("k"), F.col("of.th").alias("t"))
    # The sought nodes grow with the documents; never broadcast them.
    met = docs.join(sought.hint("merge"), (F.col("th") == F.col("t")) & F.col("key").eqNullSafe(F.col("k")))
    found = stored(met.select("node", "text").mapInArrow(run, "node long, hashes binary"), "sets")
    if found.count() == nodes.count():
        return found
    # Rows that stand for a node are repeated as a whole: any will do.
    return stored(found.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other; a set's own size is not counted."""
    m = len(sets)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.nonzero(np.r_[True, flat[1:] != flat[:-1]])[0] if len(flat) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(flat)])
    group = np.repeat(np.arange(len(starts)), sizes)
    each = sizes[group]
    common = np.zeros(m * m, np.int64)
    rare = (each > 1) & (each <= _FREQUENT)
    g, o = group[rare], owner[rare]
    for step in range(1, _FREQUENT):
        same = g[step:] == g[:-step]
        if not same.any():
            break
        common += np.bincount(o[:-step][same] * m + o[step:][same], minlength=m * m)
    common = common.reshape(m, m)
    common += common.T
    often = np.nonzero(sizes > _FREQUENT)[0]
    for at in range(0, len(often), _SLICE):
        part = often[at : at + _SLICE]
        column = np.full(len(starts), -1)
        column[part] = np.arange(len(part))
        here = column[group]
        grid = np.zeros((m, len(part)), np.float32)  # sums of ones below 2^24 are exact
        grid[owner[here >= 0], here[here >= 0]] = 1
        common += (grid @ grid.T).astype(np.int64)
    return common


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """For each item of a group of linked items its least item, where that is another one."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return [(int(r), i) for i, r in enumerate(label) if r != i]
        label = new


_UNITS = "unit struct<a:bigint,b:bigint,c:bigint>"
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _by_unit(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows in order of their unit, one unit at a time."""
    unit, rows = None, []
    for batch in batches:
        for u, *row in zip(*columns(batch, "unit", *names), strict=True):
            u = tuple(u.values())
            if u != unit:
                if rows:
                    yield unit, rows
                unit, rows = u, []
            rows.append(row)
    if rows:
        yield unit, rows


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("unit").sortWithinPartitions("unit")


def _links(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a`` < ``b`` within each unit that join the same nodes as all its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_unit(batches, "node", "hashes"):
            rows = sorted({node: hashes for node, hashes in rows}.items())
            found = [np.frombuffer(h, np.uint64) for _, h in rows]
            sizes = np.array([len(s) for s in found])
            both = overlaps(found)
            linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
            yield from emit([(rows[i][0], rows[j][0]) for i, j in _forest(linked)], _LINK)

    return _dealt(units.join(sets, "node")).mapInArrow(run, "a long, b long").distinct()


def _blocks(size: Column, weight: Column) -> Column:
    """How many blocks of bounded size that many nodes with that many shingles make."""
    return F.ceil(F.greatest(size / F.lit(_UNIT), weight / F.lit(_HELD))).cast("long")


def _first_units(members: DataFrame) -> DataFrame:
    """The least node of each bucket with the others, in blocks."""
    pairs = stored(members.where("node != pivot").select("pivot", "node", "n").distinct(), "met")
    sizes = stored(pairs.groupBy("pivot").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    unit = lambda b: F.struct(F.col("pivot").alias("a"), b.alias("b"), b.alias("c"))
    others = pairs.join(sizes, "pivot").select(unit(block).alias("unit"), "node")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = sizes.select("pivot", every.alias("block")).select(unit(F.col("block")).alias("unit"), F.col("pivot").alias("node"))
    return others.union(own)


_MEMBER = pa.schema([("unit", pa.struct([(c, pa.int64()) for c in "abc"])), ("node", pa.int64())])


def _second_units(members: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, least: int) -> DataFrame:
    """Of the buckets that nodes of several components are left in, those nodes that may have a partner.

    A block is one row, so a pair of blocks is two rows, however many nodes they hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in _by_unit(batches, "at", "block", "held"):
            held = [m for _, _, block in rows for m in block]
            block = np.repeat([b for _, b, _ in rows], [len(h) for _, _, h in rows])
            node, root, n = (np.array([m[c] for m in held], np.int64) for c in ("node", "root", "n"))
            may = root[:, None] != root[None, :]
            if unit[1] != unit[2]:  # nodes of one block meet in that block's own unit
                may &= block[:, None] != block[None, :]
            small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
            may &= 100 * small >= percent * large
            own = np.array([m["bands"] for m in held], np.int64)
            for b in range(rows[0][0]):
                may &= own[:, b][:, None] != own[:, b][None, :]
            low = np.frombuffer(b"".join(m["low"] for m in held), np.uint8).reshape(len(held), -1)
            equal = np.zeros(may.shape, np.int16)
            for column in low.T if may.any() else ():
                equal += column[:, None] == column[None, :]
            may &= equal >= least
            yield from emit([(dict(zip("abc", unit)), int(x)) for x in node[may.any(axis=1)]], _MEMBER)

    rest = members.where("size > 2").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    blocks = _blocks(F.col("size"), F.col("weight")).alias("blocks")
    rest = stored(rest.select("value", "at", "node", blocks, F.coalesce("root", "node").alias("root")), "rest")
    mixed = rest.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    rest = stored(rest.join(stored(mixed.select("value"), "mixed"), "value"), "rest")
    rest = rest.join(nodes.select("node", "n", "bands", "low"), "node")
    held = F.collect_list(F.struct("node", "root", "n", "bands", "low")).alias("held")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    rest = rest.groupBy("value", "at", "blocks", block).agg(held)
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = F.struct(
        F.col("value").alias("a"), F.least("block", "other").alias("b"), F.greatest("block", "other").alias("c")
    )
    return _dealt(rest.select(unit.alias("unit"), "at", "block", "held")).mapInArrow(run, f"{_UNITS}, node long")


def near_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 4,
    percent: int = 80,
    permutations: int = PERMUTATIONS,
    band: int = BAND,
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (the least key reachable over links, its own included) and
    ``kept`` (whether that is the key itself), one row per row of ``docs``.

    A link is 100 * intersection >= ``percent`` * union of the sets of ``words``-word shingles. Letters A-Z
    count as lower case, words are parted by ASCII blanks. Null, empty and blank texts have no shingle and
    are linked with nothing. Rows that repeat a key are documents of their own. A null key is a component's
    id only where it has no other, and is never kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        docs[key].alias("key"), F.xxhash64(docs[text]).alias("th"), docs[text].cast("string").alias("text")
    )
    prints = stored(_printed(rows, words, permutations, band), "prints")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th"))
    nodes = prints.where("n > 0").groupBy("digest").agg(
        first.alias("of"),
        F.first("n").alias("n"),
        F.first("bands").alias("bands"),
        F.first("low").alias("low"),
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", "n", F.posexplode("bands").alias("at", "value"))
    shared = entries.groupBy("value").agg(
        F.min("node").alias("pivot"), F.count("*").alias("size"), F.sum("n").alias("weight")
    )
    shared = shared.where("size > 1")
    members = stored(entries.join(stored(shared, "shared"), "value"), "members")
    near = stored(nodes.select("node", "of").join(members.select("node").distinct(), "node"), "near")
    sets = _sets(rows, near, words)
    links = stored(_links(stored(_first_units(members), "units"), sets, percent), "links")
    roots = components(links)
    # 5.6 standard deviations below the threshold.
    values = 2 * permutations
    likely = int(values * percent / 100 - 5.6 * (values * percent * (100 - percent)) ** 0.5 / 100)
    units = stored(_second_units(members, nodes, roots, percent, max(1, likely)), "units")
    more = _links(units, sets, percent)
    roots = components(links.union(more))
    placed = nodes.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    placed = stored(placed.select("digest", "of", F.coalesce("root", "node").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min(F.struct("of.none", "of.key")).alias("least"))
    ids = stored(placed.join(stored(least, "least"), "root").select("digest", F.col("least.key").alias("least")), "ids")
    out = prints.select("key", "n", "digest").join(ids, "digest", "left")
    least = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        least.alias("component_id"),
        F.coalesce(F.col("key") == least, F.lit(False)).alias("kept"),
    )
