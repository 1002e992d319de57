"""Exact dedup by skew-safe combining.

Three stages, each grouping by the digest *and* the whole normalised text, so that no decision rests on a digest
alone: (1) every map task combines its own rows, (2) the tasks' winners meet in salted groups, (3) the salts'
winners meet. A digest that stands for a third of all rows reaches stage 3 as at most ``salts`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.storage import stored

#: The characters of [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars (of the text as it came).

    A null text counts as empty and equals every text of white space only. Of equal texts the row with the most
    code points stays, then the smallest id; a null id loses to any other of the same length, and a group of
    null ids only keeps the null. Rows that repeat an id are each counted and returned, and of rows that repeat an id and
    text, as nothing tells them apart, all are kept or none. Other columns of
    ``docs`` are ignored whatever their names. An empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(normalised(text), 256).alias("text_sha256"), normalised(text).alias("body"), F.length(F.coalesce(text, F.lit(""))).alias("size"))
    # the bits turned round order ids downwards, the least of all longs included
    best = F.max(F.struct("size", F.bitwise_not("doc_id").alias("order"))).alias("best")
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("text_sha256", "body", "salt").agg(best, F.count("*").alias("copies"))
    contents = salted.repartition("text_sha256").groupBy("text_sha256", "body").agg(F.max("best").alias("best"), F.sum("copies").alias("group_size"))
    winners = contents.groupBy("text_sha256").agg(F.max("best").alias("best"), F.max("group_size").alias("group_size"), F.count("*").alias("contents"))
    keep = F.bitwise_not("best.order").alias("keep_id")
    winners = winners.select("text_sha256", keep, F.col("best.size").alias("most"), F.when(F.col("contents") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).cast("long").alias("group_size"))
    # read from a table, the winners are an input of the join like the rows, and Spark can split a hot digest's rows
    out = rows.select("doc_id", "text_sha256", "size").join(stored(winners, "winners"), "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("most"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.col("size").cast("long").alias("n_chars"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
w AS (SELECT doc_id, body, t, first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256, length(t) AS n_chars FROM w
"""


def keep_one(docs: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns; a row is known by its id, normalised text and length."""
    kept = exact_dedup(docs, **names).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha256"), F.col("n_chars").alias("_n")).distinct()
    key, text = F.col(f"`{names.get('id_col', 'doc_id')}`").cast("long"), F.col(f"`{names.get('text_col', 'text')}`")
    same = (F.sha2(normalised(text), 256) == F.col("_sha256")) & key.eqNullSafe(F.col("_id")) & (F.length(F.coalesce(text, F.lit(""))) == F.col("_n"))
    return docs.join(kept, same, "left_semi")
