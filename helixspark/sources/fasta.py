"""FASTA files as tables of reads, and the sinks of counts.

``read_fasta`` needs no index: Spark splits the text at record starts. ``read_fai`` reads an index, ``read_fasta_indexed``
the byte ranges that it names, and ``index_fasta`` makes its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.functions.sequence import decode_2bit, encode_2bit, normalise
from helixspark.operators.layout import spread
from helixspark.storage import stored

FAI_SCHEMA = "name string, len long, pos long, bases int, width int"


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """rid, name, len, pos, bases of an index: white space parts the columns, the fifth is not needed, rid is the row's number."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(fields[0].alias("name"), fields[1].cast("long").alias("len"), fields[2].cast("long").alias("pos"), fields[3].cast("int").alias("bases"), _place())
    return _numbered(rows)


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")).alias("place")


def _numbered(rows: DataFrame) -> DataFrame:
    """Number rows from 0 in the order of the files: within each split, plus what the splits before hold.

    Only a count for each split is summed in one task.
    """
    split = F.struct("place.path", "place.start")
    counts = rows.groupBy(split.alias("split")).agg(F.count("*").alias("n"))
    before = counts.select("split", (F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy(split).orderBy("place.id")) - 1
    keep = [F.col(c) for c in rows.columns if c != "place"]
    return rows.withColumn("within", within).withColumn("split", split).join(before, "split").select((F.col("before") + F.col("within")).cast("long").alias("rid"), *keep)


def read_fasta(spark: SparkSession, path: str, invalid: str = "error") -> DataFrame:
    """rid, name, seq of a FASTA file or folder; single- or multi-line records, any line ends.

    rid is the record's number from 0 in file order; name is the header up to the first white space. Records without
    bases are kept. See normalise() for ``invalid``.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", _place())
    body = F.regexp_replace("value", r"^>", "")  # only a file's first record still has it
    header = F.regexp_extract(body, r"^[^\r\n]*", 0)
    seq = F.regexp_replace(F.substr(body, F.length(header) + 1), r"\s", "")
    records = rows.where("trim(value) <> ''").select(F.regexp_extract(header, r"^\S*", 0).alias("name"), seq.alias("raw"), "place")
    return spread(_numbered(records), like=rows).select("rid", "name", normalise(F.col("raw"), invalid).alias("seq"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, split, start, value: every line of the files with the byte at which it begins.

    Each byte is in one line, so a split's first line begins where the lines of the splits before it end.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select("value", _place())
    rows = rows.select("value", F.col("place.path").alias("path"), F.col("place.start").alias("split"), F.col("place.id").alias("id"), (F.octet_length("value") + 1).cast("long").alias("size"))
    sums = rows.groupBy("path", "split").agg(F.sum("size").alias("sum"))
    sums = sums.select("path", "split", F.coalesce(F.sum("sum").over(_earlier("split")), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("path", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(sums, ["path", "split"]).select("path", "split", (F.col("before") + F.col("within")).alias("start"), "value")


def _earlier(order: str):
    """The rows of a file before a row; for tables of a row for each split."""
    return Window.partitionBy("path").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def index_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, len, pos, bases, width of a file's records, in the terms of an index: pos is the byte of the first base, bases those of the first line.

    A line's record is the last header of its split or, if that has none before it, of the splits before.
    """
    lines = _lines(spark, path).withColumn("head", F.when(F.startswith("value", F.lit(">")), F.col("start")))
    heads = lines.groupBy("path", "split").agg(F.max("head").alias("head")).select("path", "split", F.max("head").over(_earlier("split")).alias("open"))
    upto = Window.partitionBy("path", "split").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("own", F.max("head").over(upto)).join(heads, ["path", "split"]).withColumn("record", F.coalesce("own", "open")).where("record IS NOT NULL")
    text, body = F.octet_length(F.rtrim("value", F.lit("\r"))), F.col("head").isNull()
    first = lambda what: F.coalesce(F.min_by(F.when(body, what), F.when(body, F.col("start"))), F.lit(0))
    found = placed.groupBy("path", "record").agg(
        F.max(F.when(~body, F.regexp_extract("value", r"^>(\S*)", 1))).alias("name"), F.coalesce(F.sum(F.when(body, text)), F.lit(0)).alias("len"),
        F.max(F.when(~body, F.col("start") + F.octet_length("value") + 1)).alias("pos"), first(text).alias("bases"), first(F.octet_length("value") + 1).alias("width"),
    )
    return found.orderBy("path", "record").select("name", "len", "pos", "bases", "width")


def write_fai(index: DataFrame, path: str) -> None:
    index.select(F.concat_ws("\t", "name", "len", "pos", "bases", "width").alias("value")).write.text(path)


_REGION = 1 << 20


def read_fasta_indexed(spark: SparkSession, path: str, fai: str | None = None, invalid: str = "error") -> DataFrame:
    """rid, name, seq of the records that the index lists, under the index's numbers and names, from the bytes that it names.

    A record begins at its byte ``pos`` and ends after ``len`` bases, line ends not counted. What the header in the file says does
    not matter, so names may repeat. Lines and records meet in regions of a megabyte. One file, whole lines: a range that begins
    within a line loses that line.
    """
    index = read_fai(spark, fai or path + ".fai")
    # at most so many bytes, of which line ends are two a line at most
    end = F.col("pos") + F.col("len") + 2 * (F.floor(F.col("len") / F.greatest("bases", F.lit(1))) + 1)
    wanted = index.withColumn("end", end).withColumn("region", F.explode(F.sequence(F.floor(F.col("pos") / _REGION), F.floor((F.col("end") - 1) / _REGION))))
    lines = _lines(spark, path).withColumn("region", F.floor(F.col("start") / _REGION)).where(~F.startswith("value", F.lit(">")))
    held = wanted.join(lines, "region").where("start >= pos AND start < end").select("rid", "start", F.regexp_replace("value", r"\s", "").alias("value"))
    whole = held.groupBy("rid").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"])).alias("raw"))
    rows = index.join(whole, "rid", "left")
    return rows.select("rid", "name", normalise(F.substring(F.coalesce("raw", F.lit("")), F.lit(1), F.col("len").cast("int")), invalid).alias("seq"))


def write_fasta(reads: DataFrame, path: str, bases: int = 70) -> None:
    """Records with a header of the name (or rid) and lines of ``bases`` letters, in files under ``path``; a file for each task."""
    name = F.col("name") if "name" in reads.columns else F.col("rid").cast("string")
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{bases}}})", "$1\n"), F.lit("\n"))
    reads.select(F.concat(F.lit(">"), name, F.lit("\n"), body).alias("value")).write.text(path)


def reads_from(df: DataFrame, id_col: str, text_col: str, invalid: str = "error") -> DataFrame:
    """rid, name, seq of any table with an id and a sequence column; empty sequences are left out."""
    rows = spread(df.select(F.col(id_col).cast("long").alias("rid"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("raw")))
    # by the raw text, so that the sequence is not computed once for the filter and once more for the result
    some = F.col("raw").rlike("[ACGTNacgtn]") if invalid == "drop" else F.length("raw") > 0
    return rows.where(some).select("rid", "name", normalise(F.col("raw"), invalid).alias("seq"))


def append_reads(first: DataFrame, second: DataFrame) -> DataFrame:
    """rid, seq of one table of reads behind another, numbered anew from 0 in the order of their rids."""
    both = first.select(F.lit(0).alias("table"), "rid", "seq").unionByName(second.select(F.lit(1).alias("table"), "rid", "seq"))
    return numbered(both, ["table", "rid"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with an rid from 0 in the given order, in place of these columns: sorted in ranges, each after what the ranges before hold."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    keep = [c for c in rows.columns if c not in order]
    return ranged.withColumn("within", within).join(before, "range").select((F.col("before") + F.col("within")).cast("long").alias("rid"), *keep)


def from_packed(df: DataFrame, data_col: str = "data", len_col: str = "len") -> DataFrame:
    """Reads from 2-bit encodings and their lengths; other columns stay."""
    others = [c for c in df.columns if c not in (data_col, len_col)]
    return df.select(*others, decode_2bit(F.col(data_col), F.col(len_col)).alias("seq"))


def to_packed(reads: DataFrame) -> DataFrame:
    return reads.select(*[c for c in reads.columns if c != "seq"], F.length("seq").cast("long").alias("len"), encode_2bit("seq").alias("data"))


def write_reads(reads: DataFrame, path: str) -> None:
    """One sequence a line."""
    reads.select("seq").write.text(path)


def write_counts(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of k-mer, tab, count; a file for each task."""
    counts.select("kmer", "cnt").write.mode(mode).csv(path, sep="\t")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="kmer string, cnt long")


def format_histogram(histogram: DataFrame) -> str:
    """The printed histogram. It has at most a row for each count in the band."""
    rows = sorted((r.cnt, r.numkmers) for r in histogram.collect())
    return "\n".join(["#count\tnumkmers", *(f"{cnt}\t{n}" for cnt, n in rows)])
