"""Seed lists and labelled texts from tab-separated files.

Cells may be quoted, with doubled quotes and line breaks inside. Because of the line breaks one file
is read by one task, so large lists should be given as a folder of many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import strip

_FORMAT = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True}
# Cells that count as missing in a labelled file.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """First column of every non-empty line after the header, stripped; duplicates are kept."""
    raw = spark.read.csv(path, schema="name string", enforceSchema=True, **_FORMAT)
    return raw.select(strip(F.coalesce("name", F.lit(""))).alias("name"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Texts with their label; a missing text becomes an empty string."""
    raw = spark.read.csv(path, schema="text string, label string", **_FORMAT)
    present = ~F.col("text").isin(*MISSING)
    return raw.select(
        F.coalesce(F.when(present, F.col("text")), F.lit("")).alias("text"),
        strip(F.when(~F.col("label").isin(*MISSING), F.col("label"))).alias("label"),
    )
