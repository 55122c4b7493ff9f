"""Shared helpers of the llm operators: stored tables, text slices of Arrow batches, packed exchanges."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlake.session import store

#: Bytes of text that a task turns into numpy arrays at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SHIPPED = "_dunlake_package"


def ship_package(df: DataFrame) -> None:
    """Send this package to the executors, once for each Spark context.

    The tasks' functions are pickled by name, and workers need not have the package on their path. Spark's own file server
    hands the archive out, so nothing is read from a folder of the driver.
    """
    context = df.sparkSession.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    setattr(context, _SHIPPED, True)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):
        return  # imported from an archive, which is on the workers' path already
    archive = os.path.join(tempfile.mkdtemp(prefix="dunlake-code-"), "dunlake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that a kernel needs, as ``id`` long and ``text`` string; null text is empty."""
    ship_package(df)
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


#: Spark's setting to delete shuffle files when a query ends, instead of when the driver collects its objects.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that lost executors cost no recomputation.

    The shuffle files behind the table are of no more use then; Spark is told to delete them, so that a job of many
    stages needs the disk of one.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return store(df, name)
    finally:
        conf.set(_CLEANUP, before)


#: Spark's limit of an Arrow batch on its way to a task's worker; 64 MB if nobody sets it.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """What is stored meanwhile gives its kernels batches of about ``limit`` bytes; a limit that the session sets holds instead.

    The executor holds a batch in buffers that grow by doubling, and the worker holds it once more.
    """
    if spark.conf.get(_BATCH, None) is not None:
        yield
        return
    spark.conf.set(_BATCH, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Slice:
    """Consecutive texts of a batch: their ids, one byte array and the offsets of the texts in it."""

    __slots__ = ("ids", "data", "offsets")

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets

    def __len__(self) -> int:
        return len(self.ids)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def byte_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch with columns id and text into slices of about ``limit`` bytes."""
    ids = np.asarray(batch.column("id").to_numpy(zero_copy_only=False))
    data, offsets = byte_column(batch.column("text"))
    at, n = 0, len(ids)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        low, high = offsets[at], offsets[end]
        yield Slice(ids[at:end], data[low:high], offsets[at : end + 1] - low)
        at = end


def tidied(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow, after each task of which its worker gives freed memory back to the system.

    Spark keeps workers for later tasks, and the allocators of C and Arrow keep what a task has freed: 180 MB in a worker
    that encoded texts. Of jobs in a row each would find the executor filled by what is of no use to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim is not None:
                trim(0)

    return run


def binary(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def cut(order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the bounds of each one's run."""
    sorted_keys = keys[order]
    if not len(sorted_keys):
        return sorted_keys, np.zeros(1, np.int64)
    edge = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    bounds = np.concatenate(([0], edge, [len(sorted_keys)]))
    return sorted_keys[bounds[:-1]], bounds
