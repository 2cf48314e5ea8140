"""Where intermediate data goes: the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Batches = Iterator[pa.RecordBatch]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, a temporary one is set on a local master; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        to = spark.conf.get("spark.checkpoint.dir", None)
        if not to:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            to = tempfile.mkdtemp()
        context.setCheckpointDir(to)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and cut off from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder by columns: it takes less than a checkpoint, and later joins know its size from its files."""
    df.write.parquet(to := folder(df.sparkSession, name))
    return df.sparkSession.read.parquet(to)


def forget(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that the shuffles of what is checkpointed and gone leave the disk now, not when the driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns a Python worker's free memory to the system: workers outlive their tasks, and share their executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, in a worker that gives its free memory back at the end of the task."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return wrapped
