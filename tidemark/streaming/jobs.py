"""Incremental jobs: parse newly stored pages, keep the failure table current.

The checkpoint of a query takes the place of a "pending" flag: each stored file is read once. Every
sink write is keyed by the batch number, so a batch that is run again after a failure replaces its own
output. Stored results are read by newest version, so the order in which files arrive does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import urls as U
from tidemark.operators import extract as E
from tidemark.operators.ordered import latest_per_key, running_sum
from tidemark.sources.tables import KeyedTable, VersionedTable

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("original", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("stamp", T.DoubleType()),
    ]
)
ERROR_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("ts", T.DoubleType()),
    ]
)
# Keeps large state on local disk with changelogs in the checkpoint instead of in the heap.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(writer, checkpoint: str, name: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


class PageTables:
    """The tables of the parse job below one folder."""

    def __init__(self, spark: SparkSession, root: str, key: str = "page_id"):
        self.key = key
        self.layouts = VersionedTable(spark, f"{root}/layouts", [key], "stamp")
        self.rules = VersionedTable(spark, f"{root}/rules", [key], "stamp")
        self.moderators = VersionedTable(spark, f"{root}/moderators", [key], "stamp")
        self.quarantine = VersionedTable(spark, f"{root}/quarantine", [key], "stamp")


def parse_batch(
    pages: DataFrame,
    batch: int,
    tables: PageTables,
    scorer: E.Scorer,
    threshold: float = E.RULE_THRESHOLD,
) -> None:
    """Parse one batch of stored pages. A page stored twice in a batch counts with its newest copy.

    Layout results are written first and read back, so pages are shredded once. A page that yields
    nothing writes no result and leaves an earlier one in place; one that cannot be read goes to the
    quarantine.
    """
    key = tables.key
    dom = E.layout_dom(E.route(pages.select(key, "stamp", "original", "html")))
    read = latest_per_key(E.read_layouts(dom, key, "stamp"), [key], [F.col("stamp").desc()])
    tables.layouts.add(read, batch)
    layouts = tables.layouts.batch(batch, read.schema)
    tables.rules.add(E.stored_rules(layouts, key, scorer, threshold, ["stamp"]), batch)
    tables.moderators.add(E.stored_rosters(layouts, key, "stamp"), batch)
    tables.quarantine.add(E.unreadable(layouts, key, "stamp"), batch)


def parse_pending(
    pages: DataFrame,
    tables: PageTables,
    checkpoint: str,
    scorer: E.Scorer,
    threshold: float = E.RULE_THRESHOLD,
    interval: str | None = "2 minutes",
) -> StreamingQuery:
    """Parse stored pages as they arrive; ``interval=None`` handles what is there and stops."""

    def run(batch_pages: DataFrame, batch: int) -> None:
        parse_batch(batch_pages, batch, tables, scorer, threshold)

    return _start(pages.writeStream.foreachBatch(run), checkpoint, "parse_pending", interval)


def _with_state(spark: SparkSession, start) -> StreamingQuery:
    """Start a query that keeps state. It takes its settings when it starts; the session gets its own back."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    try:
        for name, value in STATE_CONF.items():
            spark.conf.set(name, value)
        return start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def track_errors(
    events: DataFrame,
    state: VersionedTable,
    checkpoint: str,
    interval: str | None = "2 minutes",
) -> StreamingQuery:
    """Keep per URL the latest error, its fatal flag and the number of errors.

    The state per URL has constant size; ``list_errors`` keeps the errors themselves.
    """
    spark = events.sparkSession
    running = events.groupBy("url").agg(
        F.max(F.struct("ts", "error_code")).alias("last"), F.count(F.lit(1)).alias("n_errors")
    )

    def run(changed: DataFrame, batch: int) -> None:
        rows = changed.select(
            "url",
            U.is_fatal(F.col("last.error_code")).alias("fatal"),
            F.col("last.error_code").alias("last_code"),
            F.col("last.ts").alias("last_ts"),
            "n_errors",
        )
        state.add(rows, batch)

    writer = running.writeStream.outputMode("update").foreachBatch(run)
    return _with_state(spark, lambda: _start(writer, checkpoint, "track_errors", interval))


_COMPACT_EVERY = 16  # batches


def _number_batch(events: DataFrame, batch: int, path: str, chunk: int) -> DataFrame:
    """Number a batch's errors after those that were seen of their URLs, and count them there.

    ``path`` has a keyed table of the numbers seen and the counts of the batch. Only numbers of batches before this
    one are looked at, so a batch that is run again gets the same.
    """
    spark = events.sparkSession
    seen = KeyedTable(spark, f"{path}/seen", "key", [T.StructField("n", T.LongType())])
    if batch and batch % _COMPACT_EVERY == 0 and not seen.empty() and not seen.holds(batch):
        seen.compact()
    key = F.coalesce(F.concat(F.lit("="), "url"), F.lit("")).alias("key")  # a URL may be null
    counts = events.groupBy("url").agg(F.count(F.lit(1)).alias("new")).select(key, "url", "new", F.lit(0).alias("old"))
    if batch and not seen.empty():
        old = seen.current(before=batch).withColumnRenamed("n", "old")
        counts = counts.drop("old").join(old, "key", "left")
    old = F.coalesce("old", F.lit(0)).cast("bigint")
    counts.select("key", "url", "new", old.alias("old")).write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.schema("key string, url string, new bigint, old bigint").parquet(f"{path}/counts")
    seen.put(counts.select("key", (F.col("old") + F.col("new")).alias("n")), batch)
    # What was seen before is one more row per URL, ahead of its errors: a running sum goes on from there, and
    # a URL with most of the errors is cut like any other.
    columns = [F.col("ts").cast("double").alias("ts"), F.col("error_code").cast("int").alias("error_code")]
    rows = events.select("url", F.lit(1).alias("at"), *columns, F.lit(1).cast("bigint").alias("step"))
    none = [F.lit(None).cast("double").alias("ts"), F.lit(None).cast("int").alias("error_code")]
    before = counts.where("old > 0").select("url", F.lit(0).alias("at"), *none, F.col("old").alias("step"))
    summed = running_sum(rows.unionByName(before), ["url"], ["at", "ts", "error_code"], {"seq": F.col("step")})
    return summed.where("at = 1").select("url", F.floor((F.col("seq") - 1) / chunk).alias("chunk"), "seq", "ts", "error_code")


def list_errors(
    events: DataFrame, log: VersionedTable, checkpoint: str, chunk: int = 1024, interval: str | None = "2 minutes"
) -> StreamingQuery:
    """Keep per URL the ordered list of its errors, numbered from 1 as they arrive, in chunks of ``chunk``.

    Errors of one batch stand in the order of time and code, later batches after earlier ones. The state of a
    URL is one number, in a keyed table beside the checkpoint; the list itself is only appended to, a partition per
    batch, so a batch that is run again replaces its own rows. ``error_lists`` brings the chunks together.
    """

    def run(rows: DataFrame, batch: int) -> None:
        log.add(_number_batch(rows.select("url", "ts", "error_code"), batch, f"{checkpoint}-seen", chunk), batch)

    return _start(events.writeStream.outputMode("append").foreachBatch(run), checkpoint, "list_errors", interval)


def error_lists(log: DataFrame) -> DataFrame:
    """(url, chunk, errors) of the rows that ``list_errors`` wrote, as ``fetchlog.error_history`` gives them."""
    entry = F.struct("seq", "ts", "error_code")
    return log.groupBy("url", "chunk").agg(F.sort_array(F.collect_list(entry)).alias("errors"))


def finish(query: StreamingQuery, timeout: int | None = None) -> None:
    """Wait for an ``availableNow`` run, without a limit unless one is given in seconds; a failed run
    raises, and so does one that is stopped at the limit."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"{query.name} did not finish in {timeout} s")
