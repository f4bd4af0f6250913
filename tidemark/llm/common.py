"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure, work_dir

# Words are runs of anything but these six ASCII blanks. Fixed value.
WORD_BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table, computed once and kept in the shared work folder; lineage ends there."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_aside(docs: DataFrame, prefix: str, *names: str) -> tuple:
    """The table with its columns that start with an operator's own ``prefix`` under other names, the
    given column names as they are now, and a function that gives a result the old names back."""
    new, i = {}, 0
    for column in docs.columns:
        if column.lower().startswith(prefix):
            while (name := f"aside_{i}") in docs.columns:
                i += 1
            new[column], i = name, i + 1
    back = {name: column for column, name in new.items()}
    renamed = docs.withColumnsRenamed(new) if new else docs
    return renamed, [new.get(n, n) for n in names], lambda df: df.withColumnsRenamed(back) if back else df


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WORD_BLANKS}]+")), F.lit(0)).cast("long")


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def emit(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as one batch of the schema; nothing for no rows."""
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema
        )
