"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so hubs are pre-aggregated and skewed joins can be split;
tables between steps are stored, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    return (
        links.join(least, "b")
        .select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        .where("x != y")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is linked with over any path, for all linked nodes.

    ``links`` has ``a`` < ``b`` of any ordered type. Nodes without links are not listed.
    """
    now, mark = stored(links.distinct(), "links"), None
    while True:
        step = stored(_small_star(_large_star(now).distinct()).distinct(), "links")
        forget(now)
        now = step
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = state
