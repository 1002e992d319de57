"""Streaming k-mer counts.

A k-mer can leave the band again by growing beyond it, so totals are kept unfiltered and the band applies to what is
read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixspark.operators import extract
from helixspark.operators.count import in_band


def streaming_counts(reads: DataFrame, k: int) -> DataFrame:
    """kmer, cnt of a stream of reads; for output modes complete and update. Every distinct k-mer is state."""
    words = extract.word_columns(k)
    totals = extract.packed_counts(reads, k).groupBy(*words).agg(F.sum("cnt").alias("cnt"))
    return totals.select(extract.unpacked(k).alias("kmer"), "cnt")


def append_counts(reads: DataFrame, k: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch's partial counts to a table, each batch once; no state is kept, and nothing reaches the driver."""
    counts = extract.packed_counts(reads, k)
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def appended_totals(spark: SparkSession, k: int, path: str, min_count: int = 1, max_count: int = 65535) -> DataFrame:
    """kmer, cnt of all that append_counts() has written so far, within the band."""
    words = extract.word_columns(k)
    parts = spark.read.schema(", ".join(f"{c} long" for c in [*words, "cnt"])).parquet(path)
    totals = banded(parts.groupBy(*words).agg(F.sum("cnt").alias("cnt")), min_count, max_count)
    return totals.select(extract.unpacked(k).alias("kmer"), "cnt")


def banded(counts: DataFrame, min_count: int, max_count: int) -> DataFrame:
    return counts.where(in_band(F.col("cnt"), min_count, max_count))
