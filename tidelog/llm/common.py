"""What the corpus operators share: the cluster's shared folder, tables kept there, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: list[tuple[SparkSession, str]] = []


@cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="tidelog-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`, which every executor sees.

    Only where the setting is absent and the master is local (tests, a single machine) a temporary folder takes its place; on a
    cluster that is an error. The folder is removed at the end of a `scratch` block or when the driver's interpreter ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = _own_root()
    path = f"{root.rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the folders made within the block at its end, so what is needed later has to be written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        made, _made[before:] = _made[before:], []
        for spark, path in made:
            _remove(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def keep(spark: SparkSession, frame: DataFrame, path: str) -> DataFrame:
    """`frame` written once as Parquet in the shared folder and read back.

    This cuts the lineage: an executor that is lost later costs no recomputation of what came before. While it is written,
    Arrow batches are small: workers cut them up anyway, and an executor holds several at a time.
    """
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(8 << 20))
    try:
        frame.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return frame.select(*columns) if columns else frame


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's limits in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Gives memory that this worker's allocators hold unused back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other libraries than glibc's
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `limit` bytes of text, so that memory stays bounded.

    A single row may be longer; it comes alone.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs `[start, start + length)`, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
