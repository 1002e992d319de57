"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word pair of a text is joined by hash to the places where templates have it, and the words are compared.
A match of text position p with template position t votes for the diagonal p - t. Neighbouring diagonals (words put in
or left out) are merged, and a merged span is verified by the share of the template's pairs that it holds. A phrase
is a template that must stand on one diagonal without a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.llm.storage import stored

# Phrases of the base labels.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

# Short notices of common licenses, as lower-case words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "under the terms of the gnu lesser general public license",
    "agpl": "under the terms of the gnu affero general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under the creative commons attribution sharealike license",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights",
}

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MERGE_WITHIN = 2
MIN_SHARE = 0.7


def words_of(text: Column) -> Column:
    """Maximal runs of digits, letters and characters beyond ASCII; A-Z are lowered."""
    # lower() also lowers letters beyond ASCII; none of them becomes a letter of a phrase or template but the Kelvin sign, taken out first
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å"))
    return F.filter(F.split(F.lower(plain), SEPARATORS), lambda w: w != "")


def _pair_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def pair_places(spark: SparkSession, templates: dict[str, str], phrases: dict[str, str]) -> DataFrame:
    """label, phrase, at, a, b, pairs: a row for each pair of neighbouring words of each template; bounded by the templates."""
    rows = []
    for table, phrase in ((templates, "false"), (phrases, "true")):
        for label, text in table.items():
            words = text.split()
            if len(words) < 2:
                raise ValueError(f"{label}: a template has two words at least, not {text!r}")
            rows += [f"('{label}', {phrase}, {i}, '{words[i]}', '{words[i + 1]}', {len(words) - 1})" for i in range(len(words) - 1)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(label, phrase, at, a, b, pairs)").withColumn("hash", _pair_hash(F.col("a"), F.col("b")))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text_hash, label, phrase, first_word, last_word, share: verified spans (words from 0, last_word of the span's last pair)."""
    spark = docs.sparkSession
    places = pair_places(spark, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    key, text = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string")
    words = docs.select(key, F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    # the outer form only because the other makes Spark split every text a second time, to filter the empty ones
    rolled = words.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "w")).withColumn("next", F.get("words", F.col("pos") + 1))
    votes = rolled.where("next IS NOT NULL").join(F.broadcast(places), (_pair_hash(F.col("w"), F.col("next")) == F.col("hash")) & (F.col("w") == F.col("a")) & (F.col("next") == F.col("b")))
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("at"))
    # a diagonal holds a template position once; equal rows of docs (same id and text) vote together
    diagonals = votes.groupBy("doc_id", "text_hash", "label", "phrase", "pairs", "diagonal").agg(F.collect_set("at").alias("hits"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"))
    diagonals = stored(diagonals, "diagonals")  # read twice below; the texts are not
    exact = diagonals.where("phrase AND size(hits) = pairs").select("doc_id", "text_hash", "label", "phrase", "first_word", "last_word", F.lit(1.0).alias("share"))
    order = Window.partitionBy("doc_id", "text_hash", "label").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > MERGE_WITHIN
    # a lone pair makes no span; it mends one whose diagonal of two pairs or more it stands beside
    strong = F.when(F.size("hits") > 1, F.col("diagonal"))
    below = F.last(strong, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(strong, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    beside = (F.col("diagonal") - F.col("below") <= MERGE_WITHIN) | (F.col("above") - F.col("diagonal") <= MERGE_WITHIN)
    loose = diagonals.where(~F.col("phrase")).withColumn("below", below).withColumn("above", above).where(beside).drop("below", "above")
    runs = loose.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(order))
    spans = runs.groupBy("doc_id", "text_hash", "label", "phrase", "pairs", "run").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    share = F.size("hits") / F.col("pairs")
    fits = F.col("last_word") - F.col("first_word") < 2 * F.col("pairs")
    merged = spans.withColumn("share", share).where((F.col("share") >= MIN_SHARE) & fits)
    return exact.unionByName(merged.select(*exact.columns))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and score 0. ``score`` is the largest share of a span, 1 where a
    phrase stands. Rows that repeat id and text get the same result each; other columns are ignored.
    """
    key, text = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string")
    spans = license_spans(docs, id_col, text_col, **options)
    base = F.when(F.col("phrase"), F.col("label"))
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.count(base).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    rows = docs.select(key, F.xxhash64(text).alias("hash"), F.size(words_of(text)).cast("long").alias("n_words")).alias("r")
    joined = rows.join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.hash") == F.col("f.text_hash")), "left")
    filled = lambda c, v: F.coalesce(F.col(f"f.{c}"), F.lit(v)).alias(c)
    return joined.select("r.doc_id", "n_words", filled("n_base", 0), "f.first_word", "f.last_word", filled("base_labels", ""), filled("labels", ""), filled("score", 0.0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
