"""Capture index responses: one JSON array of string arrays per request, row 0 is the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.functions.expr import let
from tidemark.sources.files import read_listed, relative_name

_ROWS = "array<array<string>>"
# The columns of an index response, in order.
INDEX_COLUMNS = ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length")


def read_index_files(spark: SparkSession, path: str, seeds: DataFrame) -> DataFrame:
    """(seed_url, body) from a folder with one response per file. The file of a seed URL has the URL as
    its name, made safe, and the ending ``.json``; files of no seed are left out."""
    files = spark.read.text(path, wholetext=True).select(
        relative_name(spark, path).alias("__file"), F.col("value").alias("body")
    )
    named = seeds.select("seed_url").distinct()
    named = named.withColumn("__file", index_file(F.col("seed_url")))
    return files.join(named, "__file").select("seed_url", "body")


def index_file(seed_url: Column, spread: bool = False) -> Column:
    """The file of a seed URL: the URL as its name, made safe, and the ending ``.json``. With ``spread`` it lies in
    one of 4,096 folders by a hash of the URL, as a file system's folder holds some millions of names only."""
    name = F.concat(U.sanitize_key(seed_url), F.lit(".json"))
    return F.concat(F.substring(F.md5(seed_url), 1, 3), F.lit("/"), name) if spread else name


def responses_from_files(seeds: DataFrame, root: str, spread: bool = False) -> DataFrame:
    """``seed_url``, ``body`` and ``status`` (``ok``, ``missing_file``, ``unreadable``), one row per seed URL.

    The seeds are the manifest: ``index_file`` names a seed's file.
    """
    named = seeds.select("seed_url").distinct().withColumn("__file", index_file(F.col("seed_url"), spread))
    return read_listed(named.hint("rebalance", "__file"), "__file", root, "body").drop("__file")


def _captures(body: Column) -> Column:
    """Rows after the header, or null when the response cannot be used. The body is parsed once: a
    parsed column that is filtered on would be parsed again in the filter."""

    def check(rows: Column) -> Column:
        data = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
        return F.when(F.forall(data, lambda r: F.coalesce(F.size(r) >= 3, F.lit(False))), data)

    return let(F.from_json(body, _ROWS), check)


def parse_index(responses: DataFrame) -> DataFrame:
    """One row per capture, ``pos`` = position in its response. An unusable response gives none."""

    def cell(i: int) -> Column:
        return F.try_element_at("r", F.lit(i + 1))

    return responses.select(
        "seed_url", F.posexplode(_captures(F.col("body"))).alias("pos", "r")
    ).select(
        F.col("seed_url"),
        F.col("pos"),
        cell(0).alias("urlkey"),
        cell(1).alias("ts14"),
        cell(2).alias("original"),
        cell(3).alias("mimetype"),
        cell(4).alias("statuscode"),
        cell(5).alias("digest"),
        cell(6).try_cast("bigint").alias("length"),
    )


def rejected_responses(responses: DataFrame) -> DataFrame:
    """Quarantine: responses that are no JSON array of arrays or hold a row that is too short."""
    return responses.where(_captures(F.col("body")).isNull()).select("seed_url", "body")
