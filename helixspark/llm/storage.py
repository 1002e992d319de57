"""Tables written to the folder that driver and executors share, to cut lineage or to feed two consumers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.storage import new_path

_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")  # and Spark's default
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python by 4 MB instead of 64, unless the session says otherwise.

    A batch stands in the executor's buffers and in the worker, and once more in each on its way back. The setting stays with the session.
    """
    key, default = _BATCH
    if spark.conf.get(key) == default:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages restart from files, not from lineage.

    A narrow one (a few numbers a row) goes to an eighth as many files as a shuffle has partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if narrow:
        df = df.coalesce(max(4, shuffle_width(spark) // 8))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write a table of the warehouse with one row for each ``key``, in buckets: joins by it read a bucket as a partition, without a shuffle."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    width = shuffle_width(spark)
    df.repartition(width, key).dropDuplicates([key]).write.bucketBy(width, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def trim() -> None:
    """Hand freed memory back to the system: Python workers live on for later stages, beside those stages' own."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hashed_sample(df: DataFrame, key: Column, wanted: int, rows: int) -> DataFrame:
    """At most ``wanted`` rows of a table of ``rows``, those with the smallest hashes of ``key``.

    A threshold on another hash first leaves little more than that, so that no task sorts much and few rows meet in one.
    """
    share = 1.2 * wanted / max(1, rows)
    if share < 0.8:
        df = df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 31)) < int(share * (1 << 31)))
    return df.orderBy(F.xxhash64(key), key).limit(wanted)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts that hold about ``size`` bytes of a string or binary column, at least a row each."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
