"""How communities change between half-year slots: rules, moderators, permissions, trends.

Facts are (group, slot, item) rows. A group has at most two slots per year, so the order of its slots
is a small table; items are never gathered into arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slot_number(year, half):
    """Slots as consecutive numbers."""
    return (year * 2 + half - 1).cast("int")


def set_changes(facts: DataFrame, group: str = "community", slot: str = "slot", item: str = "item") -> DataFrame:
    """(group, slot, item, change): ``added``, ``removed`` or ``kept`` against the group's previous
    observed slot. A group's first slot has nothing to compare with and gives no rows."""
    present = facts.select(group, slot, item).distinct()
    order = Window.partitionBy(group).orderBy(slot)
    # Taken from ``present``, so that both read the same exchange and the facts are made once.
    slots = (
        present.select(group, slot)
        .distinct()
        .withColumn("__next", F.lead(slot).over(order))
        .withColumn("__has_prev", F.lag(slot).over(order).isNotNull())
    )
    placed = present.join(slots, [group, slot])
    both = F.array(
        F.struct(
            F.when(F.col("__has_prev"), F.col(slot)).alias("at"),
            F.lit(True).alias("now"),
            F.lit(False).alias("before"),
        ),
        F.struct(F.col("__next").alias("at"), F.lit(False).alias("now"), F.lit(True).alias("before")),
    )
    return (
        placed.select(group, item, F.inline(both))
        .where(F.col("at").isNotNull())
        .groupBy(group, F.col("at").alias(slot), item)
        .agg(F.max("now").alias("now"), F.max("before").alias("before"))
        .select(
            group,
            slot,
            item,
            F.when(F.col("now") & F.col("before"), "kept")
            .when(F.col("now"), "added")
            .otherwise("removed")
            .alias("change"),
        )
    )


def rules_diff(facts: DataFrame) -> DataFrame:
    """Rules added and removed per community and slot."""
    return set_changes(facts).where("change <> 'kept'")


def moderator_churn(facts: DataFrame) -> DataFrame:
    """Moderators who joined, left or stayed, per community and slot."""
    count = lambda name: F.count(F.when(F.col("change") == name, True))
    return (
        set_changes(facts)
        .groupBy("community", "slot")
        .agg(count("added").alias("joined"), count("removed").alias("departed"), count("kept").alias("stayed"))
    )


def permission_changes(roster: DataFrame) -> DataFrame:
    """Slots in which a moderator's permission differs from the one in their previous slot."""
    order = Window.partitionBy("community", "username").orderBy("slot")
    once = roster.groupBy("community", "username", "slot").agg(F.max("permission").alias("permission"))
    return (
        once.withColumn("previous", F.lag(F.struct("permission")).over(order))
        .where(
            F.col("previous").isNotNull()
            & ~F.col("previous.permission").eqNullSafe(F.col("permission"))
        )
        .select(
            "community",
            "username",
            "slot",
            F.col("previous.permission").alias("old"),
            F.col("permission").alias("new"),
        )
    )


def trend(roster: DataFrame) -> DataFrame:
    """Per slot: communities seen, roster entries, mean roster size and highest karma."""
    size = roster.groupBy("slot", "community").agg(
        F.count(F.lit(1)).alias("n"), F.max("karma").alias("karma")
    )
    return size.groupBy("slot").agg(
        F.count(F.lit(1)).alias("communities"),
        F.sum("n").alias("entries"),
        F.avg("n").alias("mean_size"),
        F.max("karma").alias("top_karma"),
    )
