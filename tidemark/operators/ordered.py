"""Order-dependent operators in one range-sorted exchange, whichever keys the rows have.

Rows are dealt to buckets by ranges of (key, order), so a key with most of the rows is cut into
consecutive buckets like any other stretch, and each step is computed inside the buckets. No keys are counted
beforehand and no step sends the rows a second time:

* A row's predecessor: the first row of a bucket is the cut itself. It is dealt to the bucket before as
  well, where its predecessor stands; in its own bucket the copy only serves the next row.
* Running sums: a key that goes over a cut is the cut's own key. Its sum per bucket is a partial aggregate
  before the exchange, one row per bucket, and what came before a bucket is looked up by its number.

The cuts come from a uniform sample of fixed size, the rows with the least hash of (key, order). Everything is
lazy: sample and sums are scalar subqueries of the plan they serve.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
_GHOST = "__ghost"
_SAMPLED = 64  # rows sampled per bucket


class _Placed(NamedTuple):
    """Rows with the number of their bucket, before the exchange, and the cuts between buckets."""

    rows: DataFrame
    cuts: Column
    buckets: int

    def dealt(self) -> DataFrame:
        return self.rows.repartitionById(self.buckets, BUCKET)


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> _Placed:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct(*keys, *order)
    sample = df.select(at.alias("a")).orderBy(F.xxhash64("a"), "a").limit(_SAMPLED * n)
    every = F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")
    cut = F.transform(every, lambda i: F.get("s", F.floor(i * F.size("s") / n).cast("int")))
    cuts = sample.agg(F.sort_array(F.collect_list("a")).alias("s")).select(F.array_distinct(cut)).scalar()
    # Binary search for the number of cuts up to the row. One column per step: a single expression of all
    # would double with each.
    rows, step = df.withColumn(BUCKET, F.lit(0)), 1 << (max(1, n - 1).bit_length() - 1)
    while step:
        beyond = F.get(cuts, F.col(BUCKET) + (step - 1)) <= at
        rows = rows.withColumn(BUCKET, F.when(beyond, F.col(BUCKET) + step).otherwise(F.col(BUCKET)))
        step >>= 1
    return _Placed(rows, cuts, n)


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in buckets of about even size, each a range of (keys, order); adds the bucket's number.

    Several steps may follow on one spread, also with longer keys, as long as rows of one key stand together
    in the order of the spread. There are as many buckets as shuffle partitions.
    """
    return _placed(df, keys, order).dealt()


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, keep: bool = False
) -> DataFrame:
    """Add ``out`` = struct(v) of the preceding row of the same key, null on a key's first row.

    The struct tells "no previous row" (null) from "previous row holds null" (``out.v`` is null). With
    ``keep`` the rows stay spread for further steps.
    """
    placed = _placed(df, keys, order)
    own = F.col(BUCKET)
    is_cut = F.coalesce(F.get(placed.cuts, own - 1).eqNullSafe(F.struct(*keys, *order)) & (own > 0), F.lit(False))
    once = F.array(F.struct(own.alias(BUCKET), F.lit(False).alias(_GHOST)))
    twice = F.array(
        F.struct(own.alias(BUCKET), F.lit(True).alias(_GHOST)),
        F.struct((own - 1).alias(BUCKET), F.lit(False).alias(_GHOST)),
    )
    rows = placed.rows.select(*df.columns, F.inline(F.when(is_cut, twice).otherwise(once)))
    boxed = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(BUCKET, *keys).orderBy(*order))
    found = placed._replace(rows=rows).dealt().withColumn(out, boxed).where(~F.col(_GHOST)).drop(_GHOST)
    return found if keep else found.drop(BUCKET)


def _handed_over(sums: DataFrame, outs: Sequence[str], buckets: int) -> Column:
    """For each bucket, as an array in order, the key that the one before may share with it, and that
    key's sums so far. ``sums`` has the bucket, ``key``, the one it may hand over, and its sums there."""
    upto = Window.partitionBy("key").orderBy(BUCKET)  # at most a row per bucket
    so_far = F.struct("key", *[F.sum(f"s_{o}").over(upto).alias(o) for o in outs])
    carried = sums.select(BUCKET, so_far.alias("so_far"))
    carried = carried.select(F.col(BUCKET).alias("of"), F.lag("so_far").over(Window.orderBy(BUCKET)).alias("carry"))
    dense = sums.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    dense = dense.join(carried, F.col("b") == F.col("of"), "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("b", "carry"))), lambda x: x["carry"])
    return dense.agg(listed).scalar()


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]
) -> DataFrame:
    """Add, for each ``out -> expression``, the inclusive running sum per key in ``order``.

    ``keys`` may be empty: a running sum over the whole table. Rows that are spread already stay so.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    parts = {out: F.coalesce(expr, F.lit(0)) for out, expr in values.items()}
    if BUCKET in df.columns:
        buckets, rows = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df
        own = rows.select(BUCKET, key.alias("key"), *[v.alias(f"v_{o}") for o, v in parts.items()])
        own = own.groupBy(BUCKET, "key").agg(*[F.sum(f"v_{o}").alias(f"s_{o}") for o in parts])
        last = F.max(F.struct("key", *[f"s_{o}" for o in parts])).alias("last")
        sums = own.groupBy(BUCKET).agg(last).select(BUCKET, "last.*")
    else:
        placed = _placed(df, keys, order)
        buckets, rows = placed.buckets, placed.dealt()
        cut = F.get(placed.cuts, F.col(BUCKET))
        over = F.struct(*[cut[k].alias(k) for k in keys]) if keys else key
        own = placed.rows.select(
            BUCKET, over.alias("key"), key.eqNullSafe(over).alias("same"), *[v.alias(f"v_{o}") for o, v in parts.items()]
        )
        per = [F.sum(F.when(F.col("same"), F.col(f"v_{o}")).otherwise(F.lit(0))).alias(f"s_{o}") for o in parts]
        sums = own.groupBy(BUCKET, "key").agg(*per)  # the cut's key is one per bucket
    carry = F.get(_handed_over(sums, list(parts), buckets), F.col(BUCKET))
    upto = Window.partitionBy(BUCKET, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("*", *[F.sum(v).over(upto).alias(f"__in_{out}") for out, v in parts.items()])
    before = {o: F.coalesce(F.when(carry["key"].eqNullSafe(key), carry[o]), F.lit(0)) for o in parts}
    summed = summed.select(*rows.columns, *[(F.col(f"__in_{o}") + more).alias(o) for o, more in before.items()])
    return summed if BUCKET in df.columns else summed.drop(BUCKET)


def latest_per_key(
    df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]
) -> DataFrame:
    """One row per key, the first in ``newest_first`` order.

    Spark turns ``row_number() = 1`` into a group limit that already cuts each map task to one row
    per key, so copies of a hot key never reach the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
