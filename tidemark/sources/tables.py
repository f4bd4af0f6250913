"""Versioned tables on plain Parquet: every batch is added, readers merge on read.

A batch is written to its own partition and replaces only that partition, so replaying a batch after a
failure leaves the same table.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import latest_per_key


class KeyedTable:
    """Rows by key, changed by appends only: put whole rows, set one field, delete keys.

    All changes lie in one bucketed table, partitioned by batch: only the change itself is shuffled when it
    is written, and no row when the table is read, merged or joined by key, as files of one bucket are
    read together. ``current`` gives of each field the newest value, by version and then by batch, that is
    newer than the newest deletion. Rows without a version are older than all with one. ``compact`` puts the
    changes of some buckets together. ``buckets`` counts for a new table only: rows of one bucket
    should suit a task. The default is the number of shuffle partitions.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str, fields: Sequence[T.StructField], buckets: int | None = None
    ):
        self.spark, self.path, self.key, self.fields = spark, path, key, list(fields)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        sizes = [int(n.removeprefix("of-")) for n in there if re.fullmatch(r"of-\d+", n)]
        self.buckets = sizes[0] if sizes else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.location = f"{path.rstrip('/')}/of-{self.buckets}"
        self.name = f"keyed_{hashlib.md5(self.location.encode()).hexdigest()}"
        self._key_type: str | None = None
        if sizes:
            self._open(spark.read.parquet(self.location).schema[key].dataType)

    def _open(self, key_type: T.DataType) -> None:
        """Tell the session about the table; its files are the only state."""
        if self._key_type is not None:
            return
        self._key_type = key_type.simpleString()
        columns = [T.StructField(self.key, key_type), *self.fields, *_MARKS]
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({listed}, `__part` string) USING parquet "
            f"PARTITIONED BY (`__part`) CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )
        if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.location)):
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _write(self, rows: DataFrame, part: str) -> None:
        dealt = rows.repartition(self.buckets, self.key)  # a task writes one bucket
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.name} PARTITION (`__part` = '{part}') SELECT * FROM {{rows}}", rows=dealt
        )

    def _add(self, rows: DataFrame, batch: int, op: str, names: Sequence[str], version: str | None) -> None:
        self._open(rows.schema[self.key].dataType)
        stamp = F.col(version).cast("double") if version else F.lit(None).cast("double")
        values = [
            (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.fields
        ]
        key = F.col(self.key).cast(self._key_type).alias(self.key)
        marks = [stamp.alias("__version"), F.lit(batch).cast("bigint").alias("__seq"), F.lit(op).alias("__op")]
        self._write(rows.select(key, *values, *marks), f"batch-{batch}")

    def put(self, rows: DataFrame, batch: int, version: str | None = None) -> None:
        self._add(rows, batch, "put", [f.name for f in self.fields], version)

    def set_field(self, rows: DataFrame, field: str, batch: int, version: str | None = None) -> None:
        """Set one field by key; an unknown key becomes a new row."""
        self._add(rows, batch, field, [field], version)

    def delete(self, keys: DataFrame, batch: int, version: str | None = None) -> None:
        self._add(keys, batch, "delete", [], version)

    def _merged(self, log: DataFrame) -> tuple[DataFrame, list]:
        """Per key the newest value of each field as (at, v) and the newest deletion; and which are alive."""
        at, op = F.struct("__version", "__seq"), F.col("__op")
        newest = [
            F.max(F.when(op.isin("put", f.name), F.struct(at.alias("at"), F.col(f.name).alias("v")))).alias(f.name)
            for f in self.fields
        ]
        merged = log.groupBy(self.key).agg(*newest, F.max(F.when(op == "delete", at)).alias("__gone"))
        alive = [
            F.col(f.name).isNotNull() & (F.col("__gone").isNull() | (F.col(f"{f.name}.at") > F.col("__gone")))
            for f in self.fields
        ]
        return merged, alive

    def empty(self) -> bool:
        """Whether nothing was written yet."""
        return self._key_type is None

    def holds(self, batch: int) -> bool:
        """Whether the changes of this batch were written, and not put together with others since."""
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/__part=batch-{batch}"))

    def current(self, before: int | None = None) -> DataFrame:
        """The rows that are there now, or were by the batches ``before`` a number. In the plan the table keeps its
        buckets, so a grouping or join by key needs no exchange of it."""
        if self._key_type is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        log = self.spark.table(self.name)
        merged, alive = self._merged(log if before is None else log.where(F.col("__seq") < before))
        any_alive = alive[0]
        for one in alive[1:]:
            any_alive = any_alive | one
        values = [F.when(a, F.col(f"{f.name}.v")).alias(f.name) for a, f in zip(alive, self.fields)]
        return merged.where(any_alive).select(self.key, *values)

    def files(self, buckets: Sequence[int] | None = None) -> list[str]:
        """Paths of the files of these buckets, or of all."""
        found, listing = [], self._fs.listFiles(self.spark._jvm.org.apache.hadoop.fs.Path(self.location), True)
        while listing.hasNext():
            path = listing.next().getPath()
            number = re.search(r"_(\d{5,})(?:\.c\d+)?\.[^/]*parquet$", path.getName())
            if number and (buckets is None or int(number[1]) in buckets):
                found.append(path.toString())
        return found

    def compact(self, buckets: Sequence[int] | None = None) -> None:
        """Rewrite these buckets (or all) as one file each; other buckets are neither read nor written.

        Values keep their version and batch, and deletions stay, so changes that come late or again still
        find their place. Old files go after the new ones are there: a failure in between leaves rows
        twice, which merging undoes.
        """
        old = self.files(buckets)
        if not old:
            return
        log = self.spark.read.option("basePath", self.location).parquet(*old)
        merged, alive = self._merged(log)

        def row(op: str, at, values: dict) -> Column:
            cells = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.fields]
            marks = [at["__version"].alias("__version"), at["__seq"].alias("__seq"), F.lit(op).alias("__op")]
            return F.struct(*cells, *marks)

        names = [f.name for f in self.fields]
        first = F.col(f"{names[0]}.at")
        whole = alive[0]
        for one, name in zip(alive[1:], names[1:]):
            whole = whole & one & F.col(f"{name}.at").eqNullSafe(first)
        put = row("put", first, {n: F.col(f"{n}.v") for n in names})
        single = [F.when(a, row(n, F.col(f"{n}.at"), {n: F.col(f"{n}.v")})) for a, n in zip(alive, names)]
        gone = F.when(F.col("__gone").isNotNull(), row("delete", F.col("__gone"), {}))
        rows = F.filter(F.when(whole, F.array(put, gone)).otherwise(F.array(*single, gone)), lambda r: r.isNotNull())
        self._write(merged.select(self.key, F.inline(rows)), f"compact-{uuid.uuid4().hex}")
        for path in old:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), False)
        self.spark.catalog.refreshTable(self.name)


_MARKS = [
    T.StructField("__version", T.DoubleType()),
    T.StructField("__seq", T.LongType()),
    T.StructField("__op", T.StringType()),
]


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: str):
        self.spark = spark
        self.path = path
        self.keys = list(keys)
        self.version = version

    def add(self, rows: DataFrame, batch: int) -> None:
        (
            rows.withColumn("batch", F.lit(batch).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(self.path)
        )

    def log(self) -> DataFrame | None:
        """All versions, or null when nothing was written yet."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def batch(self, number: int, schema: T.StructType) -> DataFrame:
        """Rows of one batch; the schema is given because a table may still be without rows."""
        whole = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
        log = self.spark.read.schema(whole).parquet(self.path)
        return log.where(F.col("batch") == number).drop("batch")

    def current(self) -> DataFrame | None:
        """Newest version per key."""
        log = self.log()
        if log is None:
            return None
        newest = [F.col(self.version).desc(), F.col("batch").desc()]
        return latest_per_key(log, self.keys, newest).drop("batch")

    def compact(self, path: str) -> "VersionedTable":
        """Write the current state as batch -1 of a new table at ``path``."""
        compacted = VersionedTable(self.spark, path, self.keys, self.version)
        current = self.current()
        if current is not None:
            compacted.add(current, -1)
        return compacted
