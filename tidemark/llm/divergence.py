"""Which sources of a language differ, and by which terms: count-cell ranking.

A term's share of a group, and the value by which two shares differ, depend on two counts alone. So terms
are grouped by their pair of counts (a cell), the value is worked out once per cell, cells are ranked by
value with their multiplicities summed up, cells of one value are merged, and only the cells that hold the
wanted ranks are expanded to terms, in UTF-8 order.

Shares are integers of a thousand-millionth, p = 1 + floor(10^9 * (count + 1) / (N + V)), and the value of
p against q is floor((p - q)^2 / q); every step is integer arithmetic.

For two sources of a language the cells without a count of 0 are counted in blocks of terms; those with a
0 on one side or on both follow from each source's own counts by inclusion and exclusion, so a term costs
nothing in the sources that lack it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

LEAST_DOCUMENTS = 3
MOST_RANKS = 200
_TEXT = 1 << 23  # bytes of text counted together
_ROWS = 1 << 18  # counts of terms compared together
# A-Z lower-cased; letters and the bytes of all other code points stay, the rest parts terms.
_BLANK = 0x20
_FOLD = np.array(
    [b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else _BLANK for b in range(256)], np.uint8
)
_CELL = "lang string, s1 string, s2 string, c1 long, c2 long, m long"


def terms(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All terms of the texts in order, and the text that each stands in."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    folded = _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data else np.zeros(0, np.uint8)
    at -= at[0]
    inside = folded != _BLANK
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][np.diff(at) > 0]  # a text's first byte begins a term, and so ends the one before
    first[edge] |= inside[edge]
    last[edge[1:] - 1] |= inside[edge[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])]
    )
    return found, np.searchsorted(at, starts, "right") - 1


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of values starts in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _counted(docs: DataFrame) -> DataFrame:
    """Occurrences and documents per language, source and term, summed up over some texts at a time."""

    def counts(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lang, source, text = (table.column(c).combine_chunks() for c in ("lang", "source", "text"))
        found, doc = terms(text)
        coded = found.dictionary_encode()
        size = max(1, len(coded.dictionary))
        lang, source = lang.dictionary_encode(), source.dictionary_encode()
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        each, n = np.unique(doc.astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
        cell = group[each // size] * size + each % size
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
        starts = _runs(cell)
        df = np.diff(np.r_[starts, len(cell)])
        n = np.add.reduceat(n, starts) if len(starts) else n
        of, term = cell[starts] // size, cell[starts] % size
        return pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(of // len(source.dictionary))),
                source.dictionary.take(pa.array(of % len(source.dictionary))),
                coded.dictionary.take(pa.array(term)).cast(pa.string()),
                pa.array(n.astype(np.int64)),
                pa.array(df.astype(np.int64)),
            ],
            names=["lang", "source", "term", "n", "df"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= _TEXT:
                yield counts(held)
                held, size = [], 0
        if held:
            yield counts(held)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), exact."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, total)


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact: shares are at most 10^9 + 1."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, q)


def _cells(kept: DataFrame) -> DataFrame:
    """Terms per pair of sources (s1 < s2 of one language) and pair of counts, none of them 0."""

    def block(lang: str, term: np.ndarray, source: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``term`` numbers the terms from 0."""
        names = pa.array(sorted(set(source.to_pylist())))
        place = pa.compute.index_in(source, names).to_numpy()
        values, ranks = np.unique(n, return_inverse=True)
        grid = np.full((len(names), int(term[-1]) + 1), -1, np.int64)
        grid[place, term] = ranks
        for i in range(len(names) - 1):
            here = grid[:, grid[i] >= 0]
            j, at = np.nonzero(here[i + 1 :] >= 0)
            cell = (j * len(values) + here[i, at]) * len(values) + here[i + 1 + j, at]
            cell, times = np.unique(cell, return_counts=True)
            if len(cell):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(cell)),
                        pa.array([names[i].as_py()] * len(cell)),
                        names.take(pa.array(i + 1 + cell // len(values) ** 2)),
                        pa.array(values[cell // len(values) % len(values)]),
                        pa.array(values[cell % len(values)]),
                        pa.array(times.astype(np.int64)),
                    ],
                    names=["lang", "s1", "s2", "c1", "c2", "m"],
                )

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
        number = lang.indices.to_numpy()
        starts = _runs(number, term.indices.to_numpy())
        at = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(number)]))
        source, n = table.column("source").combine_chunks(), table.column("n").to_numpy()
        cuts = np.r_[_runs(number), len(number)]
        for a, b in zip(cuts, cuts[1:]):
            yield from block(lang.dictionary[int(number[a])].as_py(), at[a:b] - at[a], source.slice(a, b - a), n[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if len(held) >= _ROWS:  # the last term may go on
                same = pa.compute.and_(
                    pa.compute.equal(held["lang"], held["lang"][-1]), pa.compute.equal(held["term"], held["term"][-1])
                )
                whole = len(held) - pa.compute.sum(same).as_py()
                if whole:
                    yield from blocks(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from blocks(held)

    dealt = kept.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term")
    found = dealt.mapInArrow(run, _CELL)
    return found.groupBy("lang", "s1", "s2", "c1", "c2").agg(F.sum("m").alias("m"))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """The value of each source against each other one of its language, over all kept terms."""
    sides = [
        groups.select(F.col("lang").alias(f"l{i}"), F.col("source").alias(f"s{i}"), F.col("total").alias(f"t{i}"), "v")
        for i in (1, 2)
    ]
    two = sides[0].join(sides[1].drop("v"), F.col("l1") == F.col("l2")).where("s1 != s2")
    two = stored(two.select(F.col("l1").alias("lang"), "s1", "s2", "t1", "t2", "v"), "pairs")

    def value(c1: Column, c2: Column) -> Column:
        return _apart(_share(c1, F.col("t1")), _share(c2, F.col("t2"))).cast("decimal(38,0)")

    zero = F.lit(0).cast("long")
    nothing = value(zero, zero)
    own = stored(kept.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m")), "own")
    first = own.select("lang", F.col("source").alias("s1"), "c", "m").join(two, ["lang", "s1"])
    second = own.select("lang", F.col("source").alias("s2"), "c", "m").join(two, ["lang", "s2"])
    cells = stored(_cells(kept), "cells")
    other = cells.select(
        "lang", F.col("s2").alias("s1"), F.col("s1").alias("s2"), F.col("c2").alias("c1"), F.col("c1").alias("c2"), "m"
    )
    both = cells.union(other).join(two, ["lang", "s1", "s2"])
    a, b = F.col("c1"), F.col("c2")
    # All terms as if they had no count, then what those with one on either side and on both add.
    parts = [
        two.where("v > 0").select("lang", "s1", "s2", (F.col("v") * nothing).alias("x")),
        first.select("lang", "s1", "s2", (F.col("m") * (value(F.col("c"), zero) - nothing)).alias("x")),
        second.select("lang", "s1", "s2", (F.col("m") * (value(zero, F.col("c")) - nothing)).alias("x")),
        both.select(
            "lang", "s1", "s2", (F.col("m") * (value(a, b) - value(a, zero) - value(zero, b) + nothing)).alias("x")
        ),
        two.where("v = 0").select("lang", "s1", "s2", F.lit(0).cast("decimal(38,0)").alias("x")),
    ]
    parts = [p.withColumn("x", F.col("x").cast("decimal(38,0)")) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("lang", "s1", "s2").agg(F.sum("x").cast("long").alias("value")).select(
        "lang", F.col("s1").alias("source"), F.col("s2").alias("item"), "value"
    )


def _terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, most: int) -> DataFrame:
    """The terms of the first ranks of each group that are more common there than in its language."""
    cell = ["lang", "source", "n", "all"]
    cells = kept.groupBy(*cell).agg(F.count("*").alias("m"))
    cells = cells.join(groups.select("lang", "source", "total"), ["lang", "source"])
    cells = cells.join(langs.select("lang", F.col("total").alias("in_all")), "lang")
    p, q = _share(F.col("n"), F.col("total")), _share(F.col("all"), F.col("in_all"))
    cells = cells.withColumn("p", p).withColumn("q", q).where("p > q")
    cells = stored(cells.select(*cell, "m", _apart(F.col("p"), F.col("q")).alias("value")), "cells")
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    # A value after as many others as there are ranks has none, whatever their multiplicities.
    values = values.withColumn("at", F.row_number().over(falling)).where(F.col("at") <= most)
    before = F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    wanted = cells.join(values.drop("m", "at"), ["lang", "source", "value"]).drop("m")
    found = kept.join(stored(wanted, "wanted"), cell)
    same = Window.partitionBy("lang", "source", "value").orderBy("term")
    found = found.withColumn("at", F.row_number().over(same)).where(F.col("at") <= most)
    found = found.withColumn("rank", (F.col("before") + F.col("at")).cast("int")).where(F.col("rank") <= most)
    return found.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST_DOCUMENTS,
    most: int = MOST_RANKS,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how each group (lang, source) differs.

    Part ``pair`` ranks all other sources of the language, part ``term`` the first ``most`` terms that the
    group has and that are more common in it than in its language; values descending, ties by item.

    Terms are runs of letters A-Z (as lower case), a-z and all code points from U+0080 on; a language keeps
    those in at least ``least`` of its documents. Each row is a document, repeated or not. A null text,
    language or source is an empty one. A language that keeps no term has pairs of value 0. Other columns
    are ignored; an empty table gives no rows.
    """
    named = {"text": text, "lang": lang, "source": source}
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for n, c in named.items()])
    counts = _counted(rows).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = stored(counts, "counts")
    wide = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("df").alias("df"))
    wide = stored(wide.where(F.col("df") >= least).drop("df"), "wide")
    kept = stored(counts.drop("df").join(wide, ["lang", "term"]), "kept")
    of_lang = wide.groupBy("lang").agg(F.sum("all").alias("n"), F.count("*").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(
        of_lang.select("lang", "v"), "lang", "left"
    )
    v, total = F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))
    groups = groups.select("lang", "source", v.alias("v"), F.greatest(total, F.lit(1)).cast("decimal(20,0)").alias("total"))
    groups = stored(groups, "groups")
    langs = stored(of_lang.select("lang", (F.col("n") + F.col("v")).cast("decimal(20,0)").alias("total")), "langs")
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, groups).withColumn("rank", F.row_number().over(falling))
    out = ["lang", "source", "part", "item", "value", "rank"]
    found = _terms(kept, groups, langs, most)
    return pairs.withColumn("part", F.lit("pair")).select(*out).union(
        found.withColumn("part", F.lit("term")).select(*out)
    )
