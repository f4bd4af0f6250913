"""Removal of repeated passages by overlapping three-line windows, in column expressions only.

Every run of three consecutive lines is a window, known by two independent 64-bit hashes. Of the
windows with one content the first stays, in the order of key, text hash and line number; the lines
that any later one covers are removed. What stays of a document is the gaps between its covered lines.

A null text has no lines and stays null; texts under three lines, and windows of blank lines only, are
left alone. Rows with one key and one text are one document and lose lines alike. A null key is ordered
first. A run of one repeated line keeps its first line. Other columns are kept as they
are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import set_aside, stored

LINES = 3


def windows(docs: DataFrame, key: str, text: str, lines: int = LINES) -> DataFrame:
    """``ld_key``, ``ld_hash`` (of the text), ``ld_at`` (first line), ``a`` and ``b`` (content) per window."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("ld_key"),
        F.xxhash64(F.col(text)).alias("ld_hash"),
        F.transform(
            F.split(F.col(text), "\n"),
            lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(x) == "").alias("blank")),
        ).alias("l"),
    )
    rows = rows.where(F.size("l") >= lines)
    element = lambda i, j, f: F.get(F.col("l"), i + j)[f]

    def window(i):
        return F.struct(
            i.alias("ld_at"),
            F.xxhash64(*[element(i, j, "a") for j in range(lines)]).alias("a"),
            F.xxhash64(F.lit(2), *[element(i, j, "b") for j in range(lines)]).alias("b"),
            F.forall(F.slice("l", i + 1, lines), lambda x: x["blank"]).alias("blank"),
        )

    starts = F.sequence(F.lit(0), F.size("l") - lines)
    return (
        rows.select("ld_key", "ld_hash", F.inline(F.transform(starts, window))).where("NOT blank").drop("blank")
    )


def gaps(found: DataFrame, lines: int = LINES) -> DataFrame:
    """Per document with later windows: ``ld_gaps``, its uncovered (first line, number) before the last
    covered line, and ``ld_end``, the first line after that."""
    in_doc = Window.partitionBy("ld_key", "ld_hash").orderBy("ld_at")
    before = F.coalesce(F.lag("ld_at").over(in_doc) + lines, F.lit(0))
    free = F.when(F.col("ld_at") > F.col("from"), F.struct(F.col("from"), (F.col("ld_at") - F.col("from")).alias("n")))
    return (
        found.withColumn("from", before)
        .groupBy("ld_key", "ld_hash")
        .agg(F.sort_array(F.collect_list(free)).alias("ld_gaps"), (F.max("ld_at") + lines).alias("ld_end"))
    )


def later_windows(docs: DataFrame, key: str, text: str, lines: int = LINES) -> DataFrame:
    """Windows whose content stands earlier as well. Counted before they are joined back; the rows of one
    content meet in one task of the join."""
    all_windows = stored(windows(docs, key, text, lines), "windows")
    here = F.struct("ld_key", "ld_hash", "ld_at")
    first = all_windows.groupBy("a", "b").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    return all_windows.join(first, ["a", "b"]).where(~here.eqNullSafe(F.col("first"))).select("ld_key", "ld_hash", "ld_at")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """All rows and columns with repeated lines taken out of ``text``, and ``ld_lines``, ``ld_removed``,
    the numbers of lines before and of lines removed, in place of columns of these names."""
    docs, (key, text), named_back = set_aside(docs.drop("ld_lines", "ld_removed"), "ld_", key, text)
    removed = gaps(later_windows(docs, key, text, lines), lines).withColumnsRenamed(
        {"ld_key": "ld_k", "ld_hash": "ld_h"}
    )
    same = F.col(key).eqNullSafe(F.col("ld_k")) & (F.xxhash64(F.col(text)) == F.col("ld_h"))
    split = F.split(F.col(text), "\n")
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size("ld_split"))
    end = F.struct(F.col("ld_end").alias("from"), F.greatest(F.lit(0), total - F.col("ld_end")).alias("n"))
    parts = F.transform(
        F.concat("ld_gaps", F.array(end)), lambda g: F.slice("ld_split", g["from"] + 1, g["n"])
    )
    kept = F.aggregate(F.col("ld_gaps"), F.lit(0), lambda n, g: n + g["n"]) + end["n"]
    cleaned = (
        docs.join(removed, same, "left")
        .withColumn("ld_split", split)
        .withColumn("ld_lines", total)
        .withColumn("ld_removed", F.when(F.col("ld_end").isNull(), 0).otherwise(total - kept))
        .withColumn(text, F.when(F.col("ld_end").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(parts), "\n")))
        .drop("ld_k", "ld_h", "ld_gaps", "ld_end", "ld_split")
    )
    return named_back(cleaned)
