"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt into shards of bounded size, so a source with a third of all rows is
spread over many groups; the words of a shard are cut into blocks of nearly equal size. Shards get
integer numbers of blocks by highest quotients of their targets, and a seeded choice says which blocks
those are. Besides the sizes of documents only sums per source and shard are shuffled.

Null and blank texts have size 0 and are never taken; a null source is a source of its own, last in
order. Repeated rows count as often as they occur. Columns of the input may have any names: the
operator's own start with ``mix_`` until the end. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns, set_aside, stored

# Weights of the sources in the order of their names, repeating. Fixed values.
WEIGHTS = (5, 2, 1)
# Multipliers of the seeded permutations: primes above any number of blocks in a shard. Fixed values.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)
_TRIES = 48  # values tried in one pass of a search


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with ``mix_number``, their place from 0 in the global order, without a global sort task.

    Range-sorted partitions are stored and counted; the counts are one row per partition.
    """
    parts = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("mix_part", F.spark_partition_id())
        .withColumn("mix_at", F.monotonically_increasing_id()),
        "numbered",
    )
    first = parts.groupBy("mix_part").agg(F.count("*").alias("n"), F.min("mix_at").alias("mix_from"))
    before = F.sum("n").over(Window.orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1))
    first = first.select("mix_part", "mix_from", F.coalesce(before, F.lit(0)).alias("mix_before"))
    place = F.col("mix_before") + F.col("mix_at") - F.col("mix_from")
    return (
        parts.join(first, "mix_part")
        .withColumn("mix_number", place)
        .drop("mix_part", "mix_at", "mix_from", "mix_before")
    )


def _narrow(
    df: DataFrame,
    value: Callable[[Column], Column],
    reached: Callable[[float], bool],
    low: float,
    high: float,
    passes: int = 6,
) -> tuple[float, float]:
    """Close in on the point between low (not reached) and high (reached) by sums over the rows.

    One aggregation tries many points and returns a row for each of them.
    """
    for _ in range(passes):
        tries = [low + (high - low) * i / _TRIES for i in range(1, _TRIES)]
        tried = df.withColumn("mix_try", F.explode(F.lit(tries)))
        sums = tried.groupBy("mix_try").agg(F.sum(value(F.col("mix_try"))).alias("s")).collect()
        for x, s in sorted((r["mix_try"], r["s"] or 0) for r in sums):
            if reached(s):
                high = x
                break
            low = x
    return low, high


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``mix_target``: weighted shares of all words, each at most ``most`` times a source's size.

    The excess of a bounded source is shared again by weight until none is above its bound: every
    target is then ``least(most * size, level * weight)`` with one level for all. ``sources`` has
    ``mix_source``, ``mix_source_size`` and ``mix_number``, the place in the order of names.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.col("mix_number") % len(weights) + 1).cast("int")
    rows = stored(sources.withColumn("mix_weight", F.element_at(listed, place)), "sources")
    bound, weight = most * F.col("mix_source_size"), F.col("mix_weight")
    size, top = rows.agg(F.sum("mix_source_size"), F.max(bound / weight)).first()
    goal = share * float(size or 0)
    if not goal:
        return rows.withColumn("mix_target", F.lit(0.0))
    low, high = _narrow(
        rows, lambda x: F.least(bound, x * weight), lambda s: s >= goal, 0.0, float(top) * 1.000001
    )
    # Between two close levels the same sources are bounded; the level follows from the others.
    fixed = bound <= low * weight
    taken, free = rows.agg(
        F.sum(F.when(fixed, bound).otherwise(0.0)), F.sum(F.when(fixed, 0.0).otherwise(weight))
    ).first()
    level = (goal - taken) / free if free else high
    return rows.withColumn("mix_target", F.least(bound, level * weight))


def apportion(cells: DataFrame, votes: str, limit: str, seats: int, order: list[str]) -> DataFrame:
    """Adds ``mix_quota``: ``seats`` seats by highest quotients votes / (2 s + 1), at most ``limit`` each.

    With all quotients of at least v / d counted, a cell holds round(votes / d) seats; the divisor d is
    found by sums over the cells. Seats whose quotients lie together at the border go by quotient and
    then by ``order``.
    """
    v, cap = F.col(votes), F.col(limit)
    won = lambda d: F.least(cap, F.floor(v / d + 0.5)).cast("long")
    most, room = cells.agg(F.max(v), F.sum(cap)).first()
    seats = min(seats, int(room or 0))
    if seats <= 0:
        return cells.withColumn("mix_quota", F.lit(0).cast("long"))
    # Few seats are won at a high divisor. ``high`` wins at most the seats, ``low`` more or as many.
    low, high = _narrow(cells, won, lambda s: s <= seats, 1e-9, 2.0 * float(most) + 1.0)
    high, low = F.lit(high), F.lit(low)
    held = cells.withColumn("mix_quota", won(high)).withColumn("mix_top", won(low))
    missing = seats - int(held.agg(F.sum("mix_quota")).first()[0])
    if not missing:
        return held.drop("mix_top")
    # What is left between the two close divisors are few seats.
    border = held.where("mix_top > mix_quota").select(
        *order, F.explode(F.sequence(F.col("mix_quota") + 1, F.col("mix_top"))).alias("seat"), v.alias("v")
    )
    best = border.orderBy(F.desc(F.col("v") / (2 * F.col("seat") - 1)), *order).limit(missing)
    extra = best.groupBy(*[F.col(c).alias(f"x_{c}") for c in order]).agg(F.count("*").alias("mix_extra"))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"x_{c}"))
    return (
        held.join(extra, same, "left")
        .withColumn("mix_quota", F.col("mix_quota") + F.coalesce("mix_extra", F.lit(0)))
        .drop("mix_top", "mix_extra", *[f"x_{c}" for c in order])
    )


def mix(
    docs: DataFrame,
    size: str,
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block_words: int = 64,
    shard_words: int = 1 << 18,
    shard_rows: int = 4096,
    seed: int = 42,
) -> DataFrame:
    """All rows and columns of ``docs`` with what the mix takes of each.

    Adds ``source_size``, ``target`` (of the row's source), ``taken`` (words, repeats counted) and
    ``picks``: array of (start, end, times), the word ranges of the document that are taken and how
    often. A column of ``docs`` with one of these names is replaced. ``size`` names a column of word
    counts. A document is taken at most ``most`` times; a source misses its target by about half a
    block per shard at most. The same input gives the same choice.
    """
    docs = docs.drop("source_size", "target", "taken", "picks")
    docs, (size, key, source), named_back = set_aside(docs, "mix_", size, key, source)
    docs = docs.withColumn("mix_source", F.col(source).cast("string")).withColumn(
        "mix_size", F.coalesce(F.col(size).cast("long"), F.lit(0))
    )
    sources = docs.groupBy("mix_source").agg(
        F.sum("mix_size").alias("mix_source_size"), F.count("*").alias("mix_rows")
    )
    sources = numbered(sources, F.col("mix_source").isNull(), F.col("mix_source"))
    sources = source_targets(sources, weights, share, most).select(
        F.col("mix_source").alias("mix_s_source"),
        "mix_source_size",
        "mix_target",
        F.greatest(
            F.lit(1),
            F.ceil(F.col("mix_source_size") / shard_words),
            F.ceil(F.col("mix_rows") / shard_rows),
        ).alias("mix_shards"),
    )
    shard = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("mix_size")), F.col("mix_shards"))
    dealt = (
        docs.join(sources, F.col("mix_source").eqNullSafe(F.col("mix_s_source")))
        .withColumn("mix_shard", shard)
        .drop("mix_s_source")
    )
    cells = dealt.groupBy("mix_source", "mix_shard").agg(
        F.sum("mix_size").alias("mix_words"),
        F.first("mix_source_size").alias("mix_source_size"),
        F.first("mix_target").alias("mix_target"),
    )
    blocks = F.greatest(F.lit(1), F.round(F.col("mix_words") / block_words)).cast("long")
    ratio = F.col("mix_target") / F.col("mix_source_size")
    cells = stored(
        cells.where("mix_words > 0")
        .withColumn("mix_blocks", blocks)
        .withColumn("mix_votes", ratio * F.col("mix_blocks"))
        .withColumn("mix_cap", most * F.col("mix_blocks")),
        "cells",
    )
    seats = int(round(cells.agg(F.sum("mix_votes")).first()[0] or 0.0))
    quotas = apportion(cells, "mix_votes", "mix_cap", seats, ["mix_source", "mix_shard"]).select(
        F.col("mix_source").alias("mix_c_source"),
        F.col("mix_shard").alias("mix_c_shard"),
        "mix_words",
        "mix_blocks",
        "mix_quota",
    )
    # The place of a document's words in its shard.
    in_shard = Window.partitionBy("mix_source", "mix_shard").orderBy(key, "mix_size")
    ends = F.sum("mix_size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        dealt.withColumn("mix_end", ends)
        .join(quotas, F.col("mix_source").eqNullSafe(F.col("mix_c_source")) & (F.col("mix_shard") == F.col("mix_c_shard")), "left")
        .withColumn("mix_start", F.col("mix_end") - F.col("mix_size"))
    )
    m, w = F.col("mix_blocks"), F.col("mix_words")
    dice = F.xxhash64(F.lit(seed), F.col("mix_source"), F.col("mix_shard"))
    prime = F.element_at(
        F.array(*[F.lit(p).cast("long") for p in _PRIMES]), (F.pmod(dice, F.lit(len(_PRIMES))) + 1).cast("int")
    )

    def pick(i: Column) -> Column:
        """Part of the document in block i, and how often the block is taken.

        The block's place in a seeded permutation of the shard's blocks says whether it is among those
        taken once more than all.
        """
        place = F.pmod(i * prime + F.pmod(dice, m), m)
        low = F.greatest(F.col("mix_start"), F.ceil(i * w / m))
        high = F.least(F.col("mix_end"), F.ceil((i + 1) * w / m))
        times = F.floor(F.col("mix_quota") / m) + F.when(place < F.col("mix_quota") % m, 1).otherwise(0)
        return F.struct(
            (low - F.col("mix_start")).cast("long").alias("start"),
            (high - F.col("mix_start")).cast("long").alias("end"),
            times.cast("int").alias("times"),
        )

    touched = F.sequence(
        F.floor(F.col("mix_start") * m / w).cast("long"), F.floor((F.col("mix_end") - 1) * m / w).cast("long")
    )
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,times:int>>")
    picks = F.filter(F.transform(touched, pick), lambda p: (p["times"] > 0) & (p["end"] > p["start"]))
    taken = F.aggregate(
        "picks", F.lit(0).cast("long"), lambda a, p: a + (p["end"] - p["start"]) * p["times"].cast("long")
    )
    mixed = (
        placed.withColumn("picks", F.when(F.col("mix_size") > 0, picks).otherwise(nothing))
        .withColumn("taken", taken)
        .withColumn("source_size", F.col("mix_source_size"))
        .withColumn("target", F.col("mix_target"))
        .drop(*[c for c in placed.columns if c.startswith("mix_")])
    )
    return named_back(mixed)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def take(mixed: DataFrame, text: str = "text", most: int = 2) -> DataFrame:
    """The mixed table itself: a row per time a document is taken, with the words that are taken.

    A document taken whole keeps its text as it is; otherwise the taken ranges follow each other on
    lines of their own. The columns that ``mix`` added are dropped.
    """
    base = mixed.drop("source_size", "target", "taken")
    at = base.columns.index(text)
    keep = [f for f in base.schema.fields if f.name != "picks"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, picked = columns(batch, text, "picks")
            rows, cuts = [], []
            for i, (value, picks) in enumerate(zip(texts, picked, strict=True)):
                spans = None
                for time in range(1, most + 1):
                    ranges = [(p["start"], p["end"]) for p in picks if p["times"] >= time]
                    if not ranges:
                        break
                    if spans is None:
                        spans = [m.span() for m in _WORD.finditer(value)]
                    joined = [list(ranges[0])]
                    for a, b in ranges[1:]:
                        if a == joined[-1][1]:
                            joined[-1][1] = b
                        else:
                            joined.append([a, b])
                    whole = joined == [[0, len(spans)]]
                    cut = value if whole else "\n".join(value[spans[a][0] : spans[b - 1][1]] for a, b in joined)
                    rows.append(i)
                    cuts.append(cut)
            if rows:
                kept = batch.take(pa.array(rows)).drop_columns(["picks"])
                yield kept.set_column(at, kept.schema.field(at), pa.array(cuts, kept.schema.field(at).type))

    assert base.columns.index("picks") > at
    return base.mapInArrow(run, kinds)



