"""spark-submit helixspark/cli.py FASTA [OUTDIR]: print the histogram of k-mer counts, and write the k-mers."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from helixspark.config import KmerConfig
from helixspark.operators.count import count_kmers, kmer_histogram
from helixspark.sources.fasta import format_histogram, read_fasta, write_counts

log = logging.getLogger("helixspark")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    default = KmerConfig()
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("fasta")
    parser.add_argument("outdir", nargs="?")
    parser.add_argument("-k", type=int, default=default.k)
    parser.add_argument("--min-count", type=int, default=default.min_count)
    parser.add_argument("--max-count", type=int, default=default.max_count)
    parser.add_argument("--invalid", choices=("error", "as_a", "drop"), default="error")
    args = parser.parse_args(argv)
    config = KmerConfig(k=args.k, m=min(default.m, args.k - 1), min_count=args.min_count, max_count=args.max_count)
    logging.basicConfig(level=logging.INFO)
    log.info("K=%d L=%d U=%d input=%s", config.k, config.min_count, config.max_count, args.fasta)
    spark = spark or SparkSession.builder.appName("helixspark").getOrCreate()
    began = time.perf_counter()
    counts = count_kmers(read_fasta(spark, args.fasta, args.invalid), config.k, config.min_count, config.max_count).cache()
    text = format_histogram(kmer_histogram(counts))
    print(text)
    if args.outdir:
        write_counts(counts, args.outdir)
    counts.unpersist()
    log.info("%.1f s", time.perf_counter() - began)
    return text


if __name__ == "__main__":
    main()
