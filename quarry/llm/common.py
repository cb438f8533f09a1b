"""Shared plumbing: the cluster's shared folder, written tables, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.operators.reach import freed

#: Bytes of text that one numpy pass handles; a longer text forms a pass of its own.
CHUNK_BYTES = 1 << 20
#: Bytes (as Spark estimates them) that a range of a sort is made for.
RANGE_BYTES = 128 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches to Python hold BATCH_BYTES at most, where the session allows more: a
    batch of long texts otherwise stands in the JVM and in the worker at once."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a local session names none (tests, a single machine) a folder of our own is
    set; on a cluster that is an error, as executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="quarry-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends at the files,
    so a lost executor costs its own tasks only, and both readers see the same rows."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in stashed:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stashed)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ranges(docs: DataFrame) -> int:
    """Into how many ranges to sort documents: one for RANGE_BYTES of what Spark expects to
    read, but no fewer than the session deals out."""
    expected = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-expected // RANGE_BYTES), 1 << 20))


def tidy(step: Callable) -> Callable:
    """The step of a mapInArrow, after which its worker (Spark uses it again) gives freed
    memory back."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def as_bytes(column: pa.Array) -> pa.Array:
    """A string or binary Arrow column as large_binary without nulls."""
    out = column.cast(pa.large_binary())
    return pc.fill_null(out, b"") if out.null_count else out


def passes(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of the batch whose texts together hold about limit bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    i, total = 0, 0
    for j, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < batch.num_rows:
        yield i, batch.num_rows
