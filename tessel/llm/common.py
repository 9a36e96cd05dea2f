"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.shared import drop_shared, shared_dir
from tessel.sources.shared import written as checkpoint

__all__ = ["checkpoint", "compact", "crc_mod", "drop_shared", "few", "lean", "shared_dir", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame) -> DataFrame:
    """`df` in at most four tasks a core: a table written from it has no more files."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def compact(df: DataFrame, *by: str) -> DataFrame:
    """`checkpoint` in files by their bytes, not by the tasks that worked the rows out; for narrow results of work that needs its tasks.

    A file of a local disk costs two processes (chmod) that the executor starts where Hadoop has no native code.
    """
    return checkpoint(few(df.hint("rebalance", *by)))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, as texts may be long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def crc_mod(column: str, mod: int):
    """crc32 of the decimal text of a column, modulo `mod`."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def give_back() -> None:
    """Return memory that this process has freed but still holds to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(run: Callable) -> Callable:
    """A function over batches that gives memory back when it ends: Python workers live on from task to task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
