"""Stored pages: write under the community prefix, read back for the documents that point to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators.ordered import latest_per_key
from tidemark.sources.files import read_listed, relative_name, write_listed


def with_path(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("prefix", U.storage_prefix(U.community_from_path(F.col(url)))).withColumn(
        "file_path", U.file_path(F.col(url))
    )


def write_pages(pages: DataFrame, path: str, url: str = "url", mode: str = "append") -> None:
    """Partitioned by prefix. The rebalance hint gathers small prefixes into few files and splits a
    prefix that holds much of the data over many tasks."""
    with_path(pages, url).hint("rebalance", "prefix").write.mode(mode).partitionBy("prefix").parquet(
        path
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, html) from a folder tree of HTML files, one page per file. The path is relative to
    the folder, as ``urls.file_path`` gives it."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(relative_name(spark, path).alias("file_path"), F.col("value").alias("html"))
    )


def write_page_files(pages: DataFrame, root: str, url: str = "url") -> int:
    """One file per page below ``root``, where ``urls.file_path`` puts it; how many were written."""
    return write_listed(with_path(pages, url), "file_path", "html", root)


def pending(cache: DataFrame) -> DataFrame:
    return cache.where("pending")


def pages_for_docs(docs: DataFrame, store: DataFrame, version: str | None = None) -> DataFrame:
    """Documents with their stored page and a status.

    ``ok``; ``bad_url`` (no community in the original URL), ``no_path``; ``missing_file``. A path
    stored more than once counts with its newest version. Past the broadcast limit this join moves
    HTML, so it is meant for stores kept apart from their documents; the parse jobs read pages that
    carry their document's fields and need no join.
    """
    if version is not None:
        store = latest_per_key(store, ["file_path"], [F.col(version).desc()])
    store = store.select("file_path", "html", F.lit(True).alias("__found"))
    has_path = F.coalesce(F.col("file_path"), F.lit("")) != ""
    # Documents without a path would all meet in one key of the join.
    found = docs.where(has_path).join(store, "file_path", "left")
    return found.unionByName(docs.where(~has_path), allowMissingColumns=True).withColumn(
        "status",
        F.when(U.community_from_text(F.col("original")).isNull(), "bad_url")
        .when(~has_path, "no_path")
        .when(F.col("__found").isNull(), "missing_file")
        .otherwise("ok"),
    ).drop("__found")


def pages_from_files(docs: DataFrame, root: str) -> DataFrame:
    """Documents with the page that their ``file_path`` names below ``root``, and a status.

    ``ok``; ``bad_url`` (no community in the original URL); ``no_path``, ``missing_file`` or ``unreadable``.
    The documents are the manifest: only their files are opened, each where its document is, so no HTML is
    shuffled and the folder is never listed. Documents are dealt evenly first, as few of them may make
    much work.
    """
    read = read_listed(docs.hint("rebalance", "file_path"), "file_path", root, "html")
    bad = U.community_from_text(F.col("original")).isNull()
    return read.withColumn("status", F.when(bad, "bad_url").otherwise(F.col("status")))
