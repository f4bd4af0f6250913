"""Files named by the rows of a table, read and written where the rows are.

A manifest (a table with a column of paths below a root folder) says which files are opened: nothing is
listed, and files that no row names are never touched. Reading adds the file's text beside the row, so
no text is shuffled. Contents are handed on in batches of bounded size, however many files a task has.

The root may be a local path or any URI that PyArrow's file systems know; all executors must see it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH_BYTES = 32 << 20


def relative_name(spark: SparkSession, root: str) -> Column:
    """Path of the row's file below ``root``, with its escapes decoded."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    at = F.locate(folder, name)
    return F.substring(name, at + len(folder), F.length(name))


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        found, base = fs.FileSystem.from_uri(root)
    else:
        found, base = fs.LocalFileSystem(), root
    return found, base.rstrip("/")


def _inside(path: str | None) -> bool:
    """Whether a path names something below the root."""
    return bool(path) and not path.startswith("/") and ".." not in path.split("/")


def _read(store: fs.FileSystem, base: str, path: str | None) -> tuple[bytes | None, str]:
    if not path:
        return None, "no_path"
    if not _inside(path):
        return None, "missing_file"
    try:
        with store.open_input_file(f"{base}/{path}") as file:
            return file.read(), "ok"
    except OSError:
        # Only what is no file counts as missing; a store that fails makes the task fail and run again.
        if store.get_file_info(f"{base}/{path}").type in (fs.FileType.NotFound, fs.FileType.Directory):
            return None, "missing_file"
        raise


def read_listed(manifest: DataFrame, path: str, root: str, out: str = "body", status: str = "status") -> DataFrame:
    """The rows of ``manifest`` with the text of the file that ``path`` names below ``root``, and a status.

    ``ok``; ``no_path`` for a null or empty path; ``missing_file`` where there is no such file, or the path
    leaves the root; ``unreadable`` for one that is no UTF-8. Only ``ok`` rows have a text. Rows that name one file
    all get it.
    """
    kept = [f for f in manifest.schema.fields if f.name not in (out, status)]
    schema = T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField(status, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(root)

        def handed(batch: pa.RecordBatch, a: int, texts: list, states: list) -> pa.RecordBatch:
            rows = batch.slice(a, len(texts))
            return pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(texts, pa.string()), pa.array(states, pa.string())], names=names
            )

        for batch in batches:
            a, texts, states, size = 0, [], [], 0
            for name in batch.column(batch.schema.get_field_index(path)).to_pylist():
                body, state = _read(store, base, name)
                text = None
                if body is not None:
                    try:
                        text = body.decode("utf-8")
                    except UnicodeDecodeError:
                        state = "unreadable"
                texts.append(text)
                states.append(state)
                size += len(body or b"")
                if size >= _BATCH_BYTES:
                    yield handed(batch, a, texts, states)
                    a, texts, states, size = a + len(texts), [], [], 0
            if texts:
                yield handed(batch, a, texts, states)

    return manifest.select(*[f.name for f in kept]).mapInArrow(run, schema)


def write_listed(rows: DataFrame, path: str, body: str, root: str) -> int:
    """Write ``body`` of each row to the file that ``path`` names below ``root``; how many were written.

    Rows without a path or body, and paths that leave the root, write nothing. A file is written under
    another name and then moved, so readers never see half of one and a task that runs again replaces
    its files. Of rows that name one file any may win.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(root)
        made: set[str] = set()
        for batch in batches:
            done = 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not _inside(name) or text is None:
                    continue
                target = f"{base}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                hidden = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as file:
                    file.write(text.encode("utf-8"))
                store.move(hidden, target)
                done += 1
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    named = rows.select(F.col(path).alias("path"), F.col(body).cast("string").alias("body"))
    return named.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def remove_listed(manifest: DataFrame, path: str, root: str) -> int:
    """Delete the files that ``path`` names below ``root``; how many there were. Folders stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(root)
        for batch in batches:
            done = 0
            for name in batch.column(0).to_pylist():
                try:
                    if _inside(name):
                        store.delete_file(f"{base}/{name}")
                        done += 1
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    named = manifest.select(F.col(path).alias("path"))
    return named.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
