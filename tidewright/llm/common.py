"""What the operators share: the shared work folder, settled tables, Arrow columns as numpy views."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: While a table is settled: its shuffle files go when the job ends, as nothing reads them again, and
#: Python workers get texts in batches of so many bytes, however long each is.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where no checkpoint folder is set, local sessions (tests) get one in the temp folder, which is
    removed when the process ends; on a cluster, whose executors could not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{_local_base()}"
    return f"{base.rstrip('/')}/tw-{uuid.uuid4().hex}"


_LOCAL: list[str] = []


def _local_base() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidewright-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


@contextmanager
def settling(spark: SparkSession) -> Iterator[None]:
    """_WHILE for the jobs inside; the session's own settings hold again afterwards."""
    before = {k: spark.conf.get(k) for k in _WHILE}
    for k, v in _WHILE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    with settling(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tw_path = path
    return out


def lean(work: Callable) -> Callable:
    """work on Arrow batches that gives memory back to the system at the end of a task: workers live on and serve other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return run


def discard(df: DataFrame) -> None:
    """Removes the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tw_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def each_text(column: pa.Array) -> Iterator[bytes]:
    """as_bytes one at a time, so that a batch of long texts is not held twice."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the n + 1 offsets of its rows (null: empty)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of data; ends has n + 1 offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
