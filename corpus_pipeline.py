"""A corpus from raw documents to token ids: each stage takes (spark, docs, sf_dir) and returns the next one's docs.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import bpe, decontamination, exact_dedup, jaccard, toxicity
from helixspark.llm.storage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of ``docs`` that are not held out.

    Every row is judged by its own text, so rows that repeat an id may part; null and empty texts score as empty ones. Without
    labels of both kinds all rows score alike. An empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts one stays: the longest text, then the smallest id.

    A row goes or stays by its id and text together; rows that repeat both stay or go together. Null texts are empty and equal each other; a null id
    loses to any other. An empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays.

    Rows that repeat an id are one document here: they link what either links, and stay or go together. Texts without words link with
    nothing and stay, null ids lose to any other, and an empty table stays empty.
    """
    found = jaccard.jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = found.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    A row is judged by its own text, whatever other rows have its id. Null and empty texts stay, as all do without a benchmark.
    """
    key = F.xxhash64(docs["doc_id"], docs["text"])
    found = decontamination.leaks(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(bad, key == bad["_key"], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and decoded, the text that the ids give back: a row for each row of ``docs``. Null texts are empty."""
    found = bpe.decode(bpe.encode(docs))
    return found.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: The classifier, the latent space and BPE have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
