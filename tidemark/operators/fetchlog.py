"""Fetch bookkeeping: attempt logs, error history, rescue lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators.ordered import latest_per_key, running_sum

RETRIES_EXHAUSTED = 6


def _attempt_code(attempt: Column, forbidden_before: Column, url: Column) -> Column:
    """Final code of one attempt, or null when the next attempt is made."""
    status, error = attempt["status"], attempt["error"]
    may_switch = (status == 403) & url.startswith("https://") & ~forbidden_before
    return (
        F.when(error == "ssl", 4)
        .when(error == "timeout", None)
        .when(error == "connection", 2)
        .when(error.isNotNull(), 5)
        .when((status == 429) | may_switch | status.between(500, 599), None)
        .when(status.between(400, 499), 3)
        .when(status.isNotNull(), 0)
    )


def fetch_outcome(log: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Reduce an attempts log (url, attempt, status, error) to one row per URL.

    The attempts made are the first ``max_attempts`` rows of a URL by attempt, then status, then error,
    so repeated or skipped numbers lose nothing. ``error_code`` is null for a log that ends before an
    attempt decides and before the attempts run out; ``attempts`` counts those made.

    A group limit cuts each URL to its first attempts before the shuffle; they become columns of one
    aggregate, and the retry rules are folded over these.
    """
    order = Window.partitionBy("url").orderBy("attempt", "status", "error")
    made = log.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_attempts)
    slots = [
        F.min(F.when(F.col("n") == k, F.struct("status", "error"))).alias(f"a{k}")
        for k in range(1, max_attempts + 1)
    ]
    wide = made.groupBy("url").agg(F.max("n").alias("made"), *slots)
    chain = None
    forbidden = F.lit(False)
    for k in range(1, max_attempts + 1):
        code = _attempt_code(F.col(f"a{k}"), forbidden, F.col("url"))
        pair = F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(k).alias("n")))
        chain = pair if chain is None else F.coalesce(chain, pair)
        forbidden = forbidden | F.coalesce(F.col(f"a{k}.status") == 403, F.lit(False))
    ended = F.when(F.col("made") >= max_attempts, F.lit(RETRIES_EXHAUSTED))
    last = F.struct(ended.alias("code"), F.col("made").alias("n"))
    return wide.select("url", F.coalesce(chain, last).alias("r")).select(
        "url", F.col("r.code").alias("error_code"), F.col("r.n").alias("attempts")
    )


def index_outcome(calls: DataFrame, max_calls: int = 2) -> DataFrame:
    """Outcome of index requests: only a connection error (2) is tried again, up to ``max_calls``.

    The calls made are the first ``max_calls`` rows of a URL by call, then code, so repeated or skipped numbers
    lose nothing. ``error_code`` is null for a log that ends while another call is due; ``calls`` counts
    those made.
    """
    order = Window.partitionBy("url").orderBy("call", "error_code")
    made = calls.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_calls)
    slots = [F.min(F.when(F.col("n") == k, F.col("error_code"))).alias(f"c{k}") for k in range(1, max_calls + 1)]
    wide = made.groupBy("url").agg(F.max("n").alias("made"), *slots)
    ended = None
    for k in range(1, max_calls + 1):
        code = F.col(f"c{k}")
        pair = F.when(code != 2, F.struct(code.alias("code"), F.lit(k).alias("n")))
        ended = pair if ended is None else F.coalesce(ended, pair)
    last = F.struct(F.when(F.col("made") >= max_calls, F.lit(2)).alias("code"), F.col("made").alias("n"))
    return wide.select("url", F.coalesce(ended, last).alias("r")).select(
        "url",
        F.col("r.code").alias("error_code"),
        F.col("r.n").alias("calls"),
        F.coalesce(F.col("r.code") == 0, F.lit(False)).alias("has_index"),
    )


def number_errors(events: DataFrame) -> DataFrame:
    """Error log in long form: each URL's errors numbered from 1 in time order."""
    return running_sum(events, ["url"], ["ts", "error_code"], {"seq": F.lit(1).cast("bigint")})


def error_history(events: DataFrame, chunk: int = 1024) -> DataFrame:
    """Per URL the ordered list of errors, cut into chunks of bounded length.

    The key of a row is (url, chunk), for every URL: chunk 0 holds errors 1 to ``chunk``, chunk 1 the
    next ones. Nearly every URL has chunk 0 only; one with millions of errors becomes many rows instead
    of a list that a single task would have to hold.
    """
    return (
        number_errors(events)
        .withColumn("chunk", F.floor((F.col("seq") - 1) / chunk))
        .groupBy("url", "chunk")
        .agg(
            F.sort_array(F.collect_list(F.struct("seq", "ts", "error_code"))).alias("errors"),
        )
    )


def fail_state(events: DataFrame) -> DataFrame:
    """Per URL the flag of the latest error and the number of errors."""
    latest = F.max(F.struct("ts", "error_code"))
    return (
        events.groupBy("url")
        .agg(latest.alias("last"), F.count(F.lit(1)).alias("n_errors"))
        .select(
            "url",
            U.is_fatal(F.col("last.error_code")).alias("fatal"),
            F.col("last.error_code").alias("last_code"),
            F.col("last.ts").alias("last_ts"),
            "n_errors",
        )
    )


def append_errors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Error log after appending new events. Appending never rewrites what is stored."""
    return stored.unionByName(new)


def rescue_list(run_errors: DataFrame, fail: DataFrame) -> DataFrame:
    """URLs that failed in this run and whose latest error can be retried."""
    failed = run_errors.select("url").distinct()
    return fail.where(~F.col("fatal")).join(failed, "url", "left_semi").select("url")


def rescue_outcome(fail: DataFrame, second_pass: DataFrame) -> DataFrame:
    """Failure records left after the second pass: recovered URLs are removed."""
    recovered = (
        second_pass.where(F.col("error_code").isin(0, U.CACHED_CODE)).select("url").distinct()
    )
    return fail.join(recovered, "url", "left_anti")


def latest_outcome(outcomes: DataFrame) -> DataFrame:
    return latest_per_key(outcomes, ["url"], [F.col("ts").desc(), F.col("error_code").desc()])
