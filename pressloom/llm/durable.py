"""Cutting lineage so that a lost executor costs one stage, not the whole job."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names in spark.checkpoint.dir; sets one only where it is unset."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pressloom-checkpoint-"))


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(run: Callable) -> Callable:
    """run, an Arrow function of batches, with the memory it is done with given back to the machine.

    Python workers live on after their task and would otherwise keep what it took at its peak.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return whole


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)
