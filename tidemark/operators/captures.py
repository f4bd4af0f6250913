"""Capture selection: collapse the index, pick captures per half-year slot, fall back, report gaps.

A slot is (url, year, half). ``order`` is the index order, ``ts14`` then ``pos`` by default; ``pos``
breaks ties between captures of the same second.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators.ordered import BUCKET, latest_per_key, previous_value, running_sum, spread

ORDER = ("ts14", "pos")
SLOT = ("url", "year", "half")


def expand_templates(seeds: DataFrame, templates: Sequence[str], name: str = "name") -> DataFrame:
    """One row per seed and URL template. Templates are a short list, so no join is needed."""
    choices = F.array(*[F.lit(t) for t in templates])
    return seeds.withColumn("template", F.explode(choices)).withColumn(
        "url", U.url_from_template(F.col("template"), F.col(name))
    )


def collapse_digest(
    captures: DataFrame,
    key: str = "url",
    order: Sequence[str] = ORDER,
    keep: bool = False,
) -> DataFrame:
    """Drop a capture whose digest equals that of the preceding capture of the same URL.

    With ``keep`` the captures stay spread by URL and order for the walk over their slots.
    """
    marked = previous_value(captures, [key], order, "digest", "__prev", keep)
    repeated = F.col("__prev").isNotNull() & F.col("__prev.v").eqNullSafe(F.col("digest"))
    return marked.where(~repeated).drop("__prev")


def year_filter(captures: DataFrame, first: int = 2012, last: int = 2023) -> DataFrame:
    return captures.where(F.col("year").between(first, last))


def with_slot(captures: DataFrame) -> DataFrame:
    """Add year, month and half read from ``ts14``; rows without a month in 1..12 have no slot."""
    return (
        captures.withColumn("year", F.substring("ts14", 1, 4).try_cast("int"))
        .withColumn("month", F.substring("ts14", 5, 2).try_cast("int"))
        .where(U.in_month_range(F.col("month"), 1, 12) & F.col("year").isNotNull())
        .withColumn("half", U.half_year(F.col("month")))
    )


def first_per_slot(captures: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """First capture of each slot in index order."""
    return latest_per_key(captures, SLOT, [F.col(c).asc() for c in order])


def _marked(captures: DataFrame, redirect_ok: Column) -> DataFrame:
    """Each capture with whether it is rejected (``__rej``) or stops the search of its slot (``__stop``)."""
    code = F.col("error_code")
    rejected = F.coalesce(U.is_fatal(code) | ((code == 0) & ~redirect_ok), F.lit(False))
    return captures.withColumn("__rej", rejected).withColumn("__stop", ~F.col("__rej"))


def _slots(spread_marked: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each slot's part of a bucket is walked on its own; the parts, one per bucket, are put together."""
    upto = Window.partitionBy(BUCKET, *SLOT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tries = F.sum(F.col("__rej").cast("bigint")).over(upto)
    stop = F.struct(*order, "error_code", (F.col("tries") + 1).alias("attempts"), BUCKET)
    parts = spread_marked.withColumn("tries", tries).groupBy(BUCKET, *SLOT).agg(
        F.min(F.when(F.col("__stop"), stop)).alias("stop"),
        F.sum(F.col("__rej").cast("bigint")).alias("rejected"),
        F.count(F.lit(1)).alias("n"),
    )
    listed = F.collect_list(F.struct(F.col(BUCKET).alias("b"), F.col("rejected").alias("r")))
    whole = parts.groupBy(*SLOT).agg(
        F.min("stop").alias("win"), listed.alias("parts"), F.sum("n").alias("candidates")
    )
    before = F.aggregate(
        "parts",
        F.lit(0).cast("bigint"),
        lambda total, p: total + F.when(p["b"] < F.col(f"win.{BUCKET}"), p["r"]).otherwise(F.lit(0)),
    )
    return whole.select(
        *SLOT,
        F.when(F.col("win").isNull(), "exhausted")
        .when(F.col("win.error_code").isin(0, U.CACHED_CODE), "filled")
        .otherwise("deferred")
        .alias("state"),
        *[F.col(f"win.{c}").alias(c) for c in order],
        F.col("win.error_code").alias("error_code"),
        F.coalesce(F.col("win.attempts") + before, "candidates").alias("attempts"),
        "candidates",
    )


def resolve_slots(captures: DataFrame, redirect_ok: Column, order: Sequence[str] = ORDER) -> DataFrame:
    """Walk the captures of each slot in order until one stops the search.

    A fatal code, or a success that was redirected out of its slot, rejects a capture and the next
    one is tried. ``filled``: a good page, or one already cached. ``deferred``: a retryable failure, or a
    capture without an outcome yet. ``exhausted``: every capture was rejected. ``attempts`` counts the
    captures looked at. Captures that the collapse left spread need no further exchange.
    """
    if BUCKET not in captures.columns:
        captures = spread(captures, SLOT, order)
    return _slots(_marked(captures, redirect_ok), order)


class CaptureJob(NamedTuple):
    """One run over the index: the slots, the captures that were tried, the errors met, the captures to try
    again in the rescue pass, and those to fetch next."""

    slots: DataFrame
    tried: DataFrame
    errors: DataFrame
    rescue: DataFrame
    fetch: DataFrame


def capture_job(
    captures: DataFrame,
    cached: DataFrame,
    redirect_ok: Column,
    first: int,
    last: int,
    order: Sequence[str] = ORDER,
) -> CaptureJob:
    """From index rows with what is known of fetching each to slots, tried captures, errors, rescue list and
    the list for the fetcher.

    ``captures`` has url, ts14, pos, digest, error_code (what a fetch gave, null if there was none yet) and
    ``cache_key``; a key in ``cached`` is not fetched and counts as a hit. A slot's captures are tried in
    order until one is not rejected. Of the tried ones a failed fetch is an error; a page that was
    redirected out of its slot is none. Errors that can be retried make the rescue list; a tried capture
    without an outcome is the one to fetch next in its slot, as those before it were all rejected. The five
    are lazy and come from one walk over one spread of the captures.
    """
    known = cached.select("cache_key").distinct().withColumn("__hit", F.lit(True))
    rows = captures.drop("year", "month", "half").join(known, "cache_key", "left")
    rows = rows.withColumn(
        "error_code", F.when(F.col("__hit"), F.lit(U.CACHED_CODE)).otherwise(F.col("error_code"))
    ).drop("__hit")
    kept = year_filter(with_slot(collapse_digest(rows, order=order, keep=True)), first, last)
    marked = _marked(kept, redirect_ok)
    stop = F.col("__stop").cast("bigint")
    walk = running_sum(marked, SLOT, order, {"__stops": stop})
    tried = walk.where(F.col("__stops") - stop == 0).drop(BUCKET, "__rej", "__stop", "__stops")
    code = F.col("error_code")
    errors = tried.where(~code.isin(0, U.CACHED_CODE))
    return CaptureJob(
        _slots(marked, order), tried, errors, errors.where(~U.is_fatal(code)), tried.where(code.isNull())
    )


def slot_gaps(urls: DataFrame, captures: DataFrame, first: int, last: int) -> DataFrame:
    """Slots without any capture, with the widest reason: ``url``, ``year`` or ``half``.

    One aggregation over one scan: the slots seen of a URL are bits of masks of 62 slots each, so
    nothing is collected and the grid is compared inside the row.
    """
    slots = list(range(first * 2, last * 2 + 2))
    masks = [slots[i : i + 62] for i in range(0, len(slots), 62)]
    number = (F.col("year") * 2 + F.col("half") - 1).cast("int")

    def bit(part: list[int]) -> Column:
        shifted = F.call_function("shiftleft", F.lit(1).cast("bigint"), number - part[0])
        return F.when(number.between(part[0], part[-1]), shifted).otherwise(F.lit(0).cast("bigint"))

    names = [f"m{i}" for i in range(len(masks))]
    seen = captures.select("url", *[bit(p).alias(n) for n, p in zip(names, masks)], F.lit(False).alias("wanted"))
    asked = urls.select("url", *[F.lit(0).cast("bigint").alias(n) for n in names], F.lit(True).alias("wanted"))
    one = (
        asked.unionByName(seen)
        .groupBy("url")
        .agg(
            *[F.bit_or(n).alias(n) for n in names],
            F.bool_or("wanted").alias("wanted"),
            F.bool_and("wanted").alias("unseen"),
        )
        .where("wanted")
    )

    def has(slot: Column) -> Column:
        at = slot - slots[0]
        mask = F.element_at(F.array(*names), F.floor(at / 62).cast("int") + 1)
        return F.getbit(mask, (at % 62).cast("int")) == 1

    slot = F.col("slot")
    other = F.when(slot % 2 == 0, slot + 1).otherwise(slot - 1)
    return (
        one.withColumn("slot", F.explode(F.lit(slots)))
        .where(~has(slot))
        .select(
            "url",
            F.floor(slot / 2).cast("int").alias("year"),
            (slot % 2 + 1).cast("int").alias("half"),
            F.when(F.col("unseen"), "url").when(~has(other), "year").otherwise("half").alias("reason"),
        )
    )


def capture_counts(captures: DataFrame) -> DataFrame:
    return captures.groupBy("url").agg(F.count(F.lit(1)).alias("captures"))


def skip_cached(
    requests: DataFrame, cache: DataFrame, hits: bool = False, also_requested: bool = False
) -> DataFrame:
    """Requests whose cache key is not stored yet (``hits=True``: those that are).

    A page is stored under the key of its final URL, so a redirected request is never found again.
    With ``also_requested`` the keys in ``requested_key`` count as well. The stored keys are made
    distinct first; a request key shared by many rows stays on the left side, which adaptive
    execution can split.
    """
    stored = cache.select("cache_key")
    if also_requested:
        stored = stored.union(cache.select("requested_key"))
    return requests.join(stored.distinct(), "cache_key", "left_semi" if hits else "left_anti")
