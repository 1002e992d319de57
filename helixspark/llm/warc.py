"""WARC 1.1: writing captures with revisit records, reading archives, and assembling transactions.

A capture is written as three records: response (or revisit), request and metadata, the latter two naming the
first in WARC-Concurrent-To. Assembly joins them again by that identifier into one nested row per capture.

Archives are written by Spark's text writer, one record a line with CR LF CR LF as line end, so any store that
Spark writes to will do; reading goes by Content-Length alone.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm.storage import new_path, stored

ID_PREFIX = "urn:capture:"
RECORDS_PER_FILE = 3000

RECORD_SCHEMA = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are four times 40 bits, or eight base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _angled(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one capture per row of ``pages`` to gzip files under ``path``.

    Among rows whose payloads are equal and have at least ``min_revisit_bytes`` bytes the largest id is the response
    and the others are revisits of it; rows with smaller payloads are all responses. Null html is an empty
    payload, a null url the empty URI, line ends in a URL become %0D and %0A, a null id is written as an empty
    id and never is the response if another row has the same payload. Rows that repeat an id and payload have
    the same role; each gets a record of its own, under the same record id. A revisit's WARC-Refers-To is the record id of its
    response. Other columns are ignored. An empty table gives no record.
    """
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("body"))
    base = base.withColumns({"digest": base32_sha1(F.col("body").cast("binary")), "bytes": F.octet_length("body"), "mix": F.xxhash64("body")})
    # payloads are equal by SHA-1, length and another hash, as pairs of different contents with one SHA-1 are known
    same = ["digest", "bytes", "mix"]
    small = base.select("id", *same).where(F.col("bytes") >= min_revisit_bytes)
    # the payload itself never moves by digest: a payload that a third of all pages share would meet in one task
    first = stored(small.groupBy(*same).agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    roles = small.join(first, same).where(~F.col("id").eqNullSafe(F.col("first"))).select("id", *same, "first").distinct()
    roles = roles.select(F.col("id").alias("rid"), *[F.col(c).alias(f"r{c}") for c in same], "first")
    captures = base.join(roles, [F.col("id").eqNullSafe(F.col("rid")), *(F.col(c) == F.col(f"r{c}") for c in same)], "left")
    page = F.coalesce(F.col("id").cast("string"), F.lit(""))
    named = lambda of, kind: F.concat(F.lit(ID_PREFIX), of, F.lit(":"), F.col("digest"), F.lit(":"), F.lower(F.hex("mix")), F.lit(f":{kind}"))
    name = lambda kind: named(page, kind)
    revisit = F.col("first").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", _angled(name("response"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.when(revisit, _angled(named(F.col("first").cast("string"), "response")))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, status).otherwise(F.concat(status, F.col("body"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _angled(name("request"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", url), ("WARC-Concurrent-To", _angled(name("response"))), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _angled(name("metadata"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", url), ("WARC-Concurrent-To", _angled(name("response"))), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), page, F.lit("\r\npayload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n")),
    )
    lines = captures.select(F.explode(F.array(response, request, metadata)).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Inflated(io.RawIOBase):
    """The inflated bytes of one or many gzip members (each record may be a member of its own), or of a plain file."""

    def __init__(self, data: bytes):
        self.rest, self.ready, self.zipped = data, b"", data[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.zipped and not self.ready and self.rest:
            self.ready = self.unzip.decompress(self.rest, 1 << 20)
            self.rest = self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        if not self.zipped:
            self.ready, self.rest = self.rest, b""
        n = min(len(into), len(self.ready))
        into[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive; a cut last record ends the reading."""
    source = io.BufferedReader(_Inflated(data), 1 << 16)
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := source.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers.get("content-length", "0"))
        block = source.read(size)
        if len(block) < size:
            return
        yield headers, block


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def parsed(data: bytes, with_payload: bool) -> Iterator[tuple]:
    for headers, block in records(data):
        kind = headers.get("warc-type")
        payload = block.partition(b"\r\n\r\n")[2] if "http" in headers.get("content-type", "") else block
        fields = {}
        if headers.get("content-type") == "application/warc-fields":
            for line in block.decode("utf-8", "replace").split("\r\n"):
                key, colon, value = line.partition(":")
                if colon:
                    fields[key.strip()] = value.strip()
        digest, size = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None, None
        if kind == "response":
            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        yield kind, _bare(headers.get("warc-record-id")), _bare(headers.get("warc-concurrent-to")), _bare(headers.get("warc-refers-to")), headers.get("warc-target-uri"), digest, size, fields, payload if with_payload and kind == "response" else None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``: gzip (whole or by record) or plain.

    A response's digest and size are computed from its payload, not taken from its headers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def parse(batches):
        columns = [part.split()[0] for part in RECORD_SCHEMA.replace("map<string,string>", "map").split(", ")]
        for batch in batches:
            for data in batch["content"]:
                rows = []
                held = 0
                for row in parsed(bytes(data), with_payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 300
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(parse, RECORD_SCHEMA)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, request, metadata, n_requests, n_metadata.

    Request and metadata records find their response or revisit record through WARC-Concurrent-To. Where several
    name the same one, that with the smallest record id stands in the row and the count tells how many there are;
    a capture without them has null there. Records without an identifier belong to no capture.
    """
    side = F.struct("record_id", "target_uri", "fields")
    mates = lambda kind: rows.where((F.col("warc_type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(side, F.col("record_id")).alias(kind), F.count("*").alias(f"n_{kind}"))
    main = rows.where(F.col("warc_type").isin("response", "revisit") & F.col("record_id").isNotNull())
    main = main.select("record_id", F.struct("warc_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"))
    return main.join(mates("request"), "record_id", "left").join(mates("metadata"), "record_id", "left")


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back, assemble, and report each page's record."""
    path = new_path(spark, "warc")
    write_warc(pages, path)
    # parsed once; the records' kinds are then read from a table
    captures = assemble(stored(read_warc(spark, path, with_payload=False).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary")))
    number = lambda c: F.when(c != "", c).cast("long")
    page = number(F.col("metadata.fields")["page-id"])
    captures = captures.select(
        "record_id",
        page.alias("page_id"),
        F.coalesce(F.col("response.payload_bytes"), F.col("metadata.fields")["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
    )
    captures = stored(captures, "captures")
    targets = captures.where("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.max("page_id").alias("refers_to"))
    return captures.join(targets, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha1(body), strlen(body)) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
