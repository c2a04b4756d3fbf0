"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import checkpointed, fresh_path, shared_dir

__all__ = ["checkpointed", "delete", "free_name", "fresh_path", "read_table", "recording", "release", "shared_dir", "sized", "stored", "text_or_empty", "utf8_slices", "written"]

#: Folders that stored() has written and release() has not deleted, oldest first.
_written: list[str] = []
_of_thread = threading.local()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """A checkpointed df in as many partitions as its rows call for, if that is fewer than it has."""
    n = max(1, -(-df.count() // rows_per_task))
    return df.coalesce(n)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; columns can be pruned on reading. release() deletes it."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    _written.append(path)
    for own in getattr(_of_thread, "lists", ()):
        own.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The folders of stored() that are still there, oldest first."""
    return list(_written)


@contextmanager
def recording() -> Iterator[list[str]]:
    """A list of the folders that stored() writes in this thread meanwhile, oldest first; what other threads store is not on it."""
    own: list[str] = []
    _of_thread.lists = [*getattr(_of_thread, "lists", ()), own]
    try:
        yield own
    finally:
        _of_thread.lists = [x for x in _of_thread.lists if x is not own]


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of stored() that no DataFrame will read again."""
    for path in paths:
        delete(spark, path)
        _written.remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until df has no such column, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_slices(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; a longer row comes alone.

    Nulls count as empty texts. Offsets start at 0 and have one entry more than there are rows.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
