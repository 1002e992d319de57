"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixspark.llm import bpe, decontamination, exact_dedup, jaccard, licenses, repeats, secrets, token_files, toxicity, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeats": repeats.query,
        "op2_toxicity": toxicity.query,
        "op3_jaccard_join": jaccard.query,
        "op4_warc": warc.query,
        "op5_token_files": token_files.query,
        "op6_secrets": secrets.query,
        "op7_byte_bpe": lambda spark, sf_dir: bpe.round_trip(documents(spark, sf_dir)),
        "op8_decontamination": decontamination.query,
        "op9_licenses": licenses.query,
        "op10_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(documents(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_repeats": repeats.ORACLE_SQL, "op3_jaccard_join": jaccard.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
