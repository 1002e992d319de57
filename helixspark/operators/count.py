"""Counting canonical k-mers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.config import check_band, check_length
from helixspark.operators import extract


def in_band(cnt: Column, min_count: int, max_count: int) -> Column:
    check_band(min_count, max_count)
    return cnt.between(min_count, max_count)


def packed_totals(reads: DataFrame, k: int) -> DataFrame:
    return extract.packed_counts(reads, k).groupBy(*extract.word_columns(k)).agg(F.sum("cnt").alias("cnt"))


def all_counts(reads: DataFrame, k: int, method: str = "packed") -> DataFrame:
    """kmer, cnt of every canonical k-mer. ``method`` is 'packed' (integer keys) or 'text' (built-in functions only)."""
    check_length("k", k)
    if method == "packed":
        return packed_totals(reads, k).select(extract.unpacked(k).alias("kmer"), "cnt")
    if method == "text":
        return extract.canonical_kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("cnt"))
    raise ValueError(f"method must be packed or text, not {method}")


def count_kmers(reads: DataFrame, k: int = 31, min_count: int = 15, max_count: int = 40, with_positions: bool = False, method: str = "packed") -> DataFrame:
    """kmer, cnt of the canonical k-mers whose total count lies in the band, both ends included.

    With positions there is also occ, an ordered array of (rid, pos), pos being 0-based in the read as it stands.
    Counts are made and filtered first, so that occurrences of very frequent k-mers are never gathered.
    """
    check_length("k", k)
    keep = in_band(F.col("cnt"), min_count, max_count)
    if not with_positions:
        if method == "packed":
            return packed_totals(reads, k).where(keep).select(extract.unpacked(k).alias("kmer"), "cnt")
        return all_counts(reads, k, method).where(keep)
    found = occurrences(reads, k, min_count, max_count, method)
    return found.groupBy("kmer").agg(F.max("cnt").alias("cnt"), F.array_sort(F.collect_list(F.struct("rid", "pos"))).alias("occ"))


def occurrences(reads: DataFrame, k: int, min_count: int, max_count: int, method: str = "packed") -> DataFrame:
    """kmer, cnt, rid, pos: a row for each occurrence of a k-mer in the band."""
    keep = in_band(F.col("cnt"), min_count, max_count)
    if method == "packed":
        words = extract.word_columns(k)
        rows = extract.packed_occurrences(reads, k, max_count).join(packed_totals(reads, k).where(keep), words)
        return rows.select(extract.unpacked(k).alias("kmer"), "cnt", "rid", "pos")
    return extract.canonical_kmers(reads, k).join(all_counts(reads, k, method).where(keep), "kmer").select("kmer", "cnt", "rid", "pos")


def partial_counts(reads: DataFrame, k: int, parts: int) -> DataFrame:
    """part, kmer, cnt: unfiltered counts of ``parts`` shares of the reads."""
    split = reads.withColumn("part", F.pmod("rid", F.lit(parts)).cast("int"))
    rows = extract.canonical_kmers(split.select(F.col("part").alias("rid"), "seq"), k).withColumnRenamed("rid", "part")
    return rows.groupBy("part", "kmer").agg(F.count("*").alias("cnt"))


def merge_counts(partial: DataFrame, min_count: int = 1, max_count: int = 65535) -> DataFrame:
    """Totals of partial counts, filtered after the sum."""
    return partial.groupBy("kmer").agg(F.sum("cnt").alias("cnt")).where(in_band(F.col("cnt"), min_count, max_count))


def kmer_histogram(counts: DataFrame) -> DataFrame:
    """cnt, numkmers of the k-mers in ``counts``, ascending; empty bins are left out."""
    return counts.groupBy("cnt").agg(F.count("*").alias("numkmers")).orderBy("cnt")


def max_count(counts: DataFrame) -> DataFrame:
    return counts.agg(F.max("cnt").alias("max_cnt"))


def surviving(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("n_kmers"))


def distinct_total(reads: DataFrame, k: int) -> DataFrame:
    """Distinct canonical k-mers and all occurrences."""
    return packed_totals(reads, k).agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_total"))


def read_lengths(reads: DataFrame) -> DataFrame:
    return reads.select("rid", F.length("seq").cast("long").alias("len"))


def totals(reads: DataFrame, k: int) -> DataFrame:
    """Reads, bases, longest read, bytes of the 2-bit form, reads shorter than k, and k-mers."""
    n = F.length("seq")
    return reads.agg(
        F.count("*").alias("n_reads"), F.sum(n).cast("long").alias("n_bases"), F.max(n).cast("long").alias("max_len"), F.sum(F.floor((n + 3) / 4)).cast("long").alias("n_bytes"),
        F.count(F.when(n < k, 1)).alias("n_short"), F.sum(F.greatest(n - (k - 1), F.lit(0))).cast("long").alias("n_kmers"),
    )


def top_kmers(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent k-mers; ties in order of the text."""
    return counts.orderBy(F.desc("cnt"), "kmer").limit(n)


def most_frequent(reads: DataFrame, k: int, n: int) -> DataFrame:
    """kmer, cnt of the n most frequent canonical k-mers of all counts; ties in order of the text. The same as top_kmers of all_counts.

    The reads are gone through twice. n k-mers are first found to occur at least ``least`` times, so the n most frequent do too, and so does
    the bin of each. In the second pass only k-mers of bins with as many occurrences are counted; where no k-mer is frequent that is all of them.
    """
    bounds = extract.count_bounds(reads, k, n).toArrow()
    bins, counts = (bounds.column(c).to_numpy() for c in ("bin", "cnt"))
    binned = bounds.column("bin").is_valid().to_numpy()
    found = np.sort(counts[~binned])[::-1]
    least = found[n - 1] if 0 < n <= len(found) else 0
    total = np.zeros(extract.BINS, np.int64)
    total[bins[binned].astype(np.int64)] = counts[binned]
    words = extract.word_columns(k)
    sums = extract.packed_counts(reads, k, total >= least).groupBy(*words).agg(F.sum("cnt").alias("cnt"))
    return sums.orderBy(F.desc("cnt"), *words).limit(n).select(extract.unpacked(k).alias("kmer"), "cnt")  # packed words sort as the text
