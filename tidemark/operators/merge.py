"""Keyed merges on plain tables: whole-row upsert, field upsert, delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import latest_per_key


def upsert_rows(
    stored: DataFrame, new: DataFrame, keys: Sequence[str], version: str
) -> DataFrame:
    """Whole-row replace by key: the newest version wins, new rows win ties."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = [F.col(version).desc(), F.col("__new").desc()]
    return latest_per_key(both, keys, newest).drop("__new")


def upsert_field(
    stored: DataFrame, new: DataFrame, key: str, field: str, version: str | None = None
) -> DataFrame:
    """Set one field by key and keep every other field; unknown keys become new rows."""
    fresh = new
    if version is not None:
        fresh = latest_per_key(new, [key], [F.col(version).desc()])
    if field not in stored.columns:
        stored = stored.withColumn(field, F.lit(None).cast(new.schema[field].dataType))
    fresh = fresh.select(key, F.col(field).alias("__value"), F.lit(True).alias("__set"))
    value = F.when(F.col("__set"), F.col("__value")).otherwise(F.col(field)).alias(field)
    return stored.join(fresh, key, "full_outer").select(
        *[value if c == field else F.col(c) for c in stored.columns]
    )


def delete_by_key(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")
