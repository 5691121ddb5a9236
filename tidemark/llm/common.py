"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import clear, paths, shared_dir, written

#: Rows of an Arrow batch.
BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    The folder stays, since what is returned reads from it: settled deletes those on the way to a stored result, and
    tidemark.shared.clear all of them once results are consumed.
    """
    spark = df.sparkSession
    path = written(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make gives, stored; all that was stored on the way is deleted. Nothing refers to that any more, lost executors or not."""
    before = paths()
    out = materialise(make(), label)
    clear(out.sparkSession, [out.stored_at], before)
    return out


def bucketed(df: DataFrame, label: str, *columns: str, sort: bool = False) -> DataFrame:
    """df as a table of the shared folder, bucketed by columns as joins and groups in this session are dealt: those need no exchange of it."""
    spark = df.sparkSession
    name = f"tidemark_{label}_{uuid.uuid4().hex}"
    path = written(f"{shared_dir(spark).rstrip('/')}/{name}", name)
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns)
    (writer.sortBy(*columns) if sort else writer).option("path", path).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def bounded(df: DataFrame) -> DataFrame:
    """df, once the session sends at most BATCH rows at a time to Python: texts may be long, and a batch is held whole on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH:
        df.sparkSession.conf.set(name, str(BATCH))
    return df


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and the next task may need other things."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8(col: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A binary column without nulls as one uint8 array and its offsets (length + 1, from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def slices(n: int, offsets: np.ndarray, limit: int):
    """Row ranges [a, b) whose bytes stay near limit; a longer row stands alone."""
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
