"""Byte-level BPE by a global shuffle of distinct words, and decoding through the token-byte table.

Texts are split into blocks. A block numbers its pre-tokens and keeps their positions as a sequence of numbers; its
distinct words go to buckets by hash. A bucket encodes each word once however many blocks hold it, and sends the ids
back to the blocks, which put them in place of the numbers. Both uses of a block read one exchange.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixspark.llm import pretokens
from helixspark.llm.storage import bound_batches, parts, shuffle_width, trim

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 16 << 20
_SEPARATOR = b"\xff"  # in no UTF-8 text
_BLOCK = "block long, docs array<long>, counts array<int>, numbers binary, places binary, words array<binary>"


def ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _packed(numbers: np.ndarray) -> bytes:
    """uint32 numbers by byte planes, as the upper planes of frequency ranks are nearly all zeros."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(pattern: str, buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pretokens.splitter(pattern)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        docs, sequences, words, held, made = [], [], pretokens.Numbering(), 0, 0

        def block() -> pa.RecordBatch:
            counts = [len(s) for s in sequences]
            numbers = np.concatenate(sequences) if sequences else np.zeros(0, np.uint32)
            coded = [w.encode() for w in words]
            # what the block is made of goes before it is packed
            sequences.clear()
            words.clear()
            by_count = np.argsort(-np.bincount(numbers, minlength=len(coded)), kind="stable")
            rank = np.empty(len(coded), np.uint32)
            rank[by_count] = np.arange(len(coded), dtype=np.uint32)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in coded), np.int64, len(coded))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(coded), np.uint32)  # of a word in the list by buckets
            place[order] = np.arange(len(coded), dtype=np.uint32)
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            parts = [_SEPARATOR.join(map(coded.__getitem__, order[a:b].tolist())) for a, b in zip(ends - np.bincount(bucket, minlength=buckets), ends, strict=True)]
            row = {"block": [first + made], "docs": [docs], "counts": [counts], "numbers": [_packed(rank[numbers])], "places": [zstandard.compress(place[by_count].tobytes())], "words": [parts]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("numbers", pa.binary()), ("places", pa.binary()), ("words", pa.list_(pa.binary()))]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                docs.append(doc)
                sequences.append(words.of(text, split))
                held += len(text)
                if held >= block_bytes:
                    yield block()
                    docs, sequences, words, held, made = [], [], pretokens.Numbering(), 0, made + 1
                    trim()
        if docs:
            yield block()
        docs, sequences, words = [], [], pretokens.Numbering()
        trim()

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, parts in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
            for bucket, words in enumerate(parts.as_py()):
                if words:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "block": [block], "words": [words]})


def _encode_bucket(vocabulary, pattern: str):
    def run(table: pa.Table) -> pa.Table:
        import tiktoken

        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(vocabulary.value), special_tokens={})._core_bpe
        known: dict[bytes, bytes] = {}  # each distinct word of the bucket is encoded once
        out = []
        for data in table.column("words").to_pylist():
            ids = []
            for word in data.split(_SEPARATOR):
                if (found := known.get(word)) is None:
                    found = known[word] = np.array(core.encode_single_piece(word), "<u4").tobytes()
                ids.append(found)
            counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
            out.append(zstandard.compress(len(ids).to_bytes(4, "little") + counts.tobytes() + b"".join(ids)))
        known.clear()
        trim()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "ids": pa.array(out, pa.binary())})

    return run


_CHUNK = 4 << 20  # bytes of ids in a record batch
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _reassemble(blocks: pa.Table, encoded: pa.Table) -> pa.Table:
    out, docs, ids, counts, held = [], [], [], [], 0
    lengths, flat = [], []
    for i in np.argsort(encoded.column("bucket").to_numpy(), kind="stable"):
        data = zstandard.decompress(encoded.column("ids")[int(i)].as_py())
        n = int.from_bytes(data[:4], "little")
        lengths.append(np.frombuffer(data, np.uint32, n, 4))
        flat.append(np.frombuffer(data, np.uint32, offset=4 + 4 * n))
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.uint32)
    ids_of = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    start = pretokens.offsets(length)
    for row in range(blocks.num_rows):
        numbers = _unpacked(blocks.column("numbers")[row].as_py())
        places = np.frombuffer(zstandard.decompress(blocks.column("places")[row].as_py()), np.uint32)
        at = 0
        for doc, n in zip(blocks.column("docs")[row].as_py(), blocks.column("counts")[row].as_py(), strict=True):
            place = places[numbers[at : at + n]]
            found = pretokens.gather(ids_of, start[place], length[place].astype(np.int64))
            at += n
            docs.append(doc)
            counts.append(len(found))
            ids.append(found.astype("<u4").tobytes())
            held += len(ids[-1])
            if held > _CHUNK:
                out.append(pa.record_batch([docs, counts, ids], schema=_ENCODED))
                docs, ids, counts, held = [], [], [], 0
    trim()
    return pa.Table.from_batches([*out, pa.record_batch([docs, counts, ids], schema=_ENCODED)])


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint32) of each row, without special tokens.

    A null text is an empty text and has no ids. Rows that repeat an id are each encoded; a null id stays null.
    Other columns are ignored. A text of any length is encoded whole; it belongs to one block.
    """
    spark = docs.sparkSession
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # bounded: a vocabulary, not data
    bound_batches(spark)
    width = shuffle_width(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # every consumer takes all columns, so that the exchange is one and the same for both
    blocks = texts.mapInArrow(_blocks(pattern, width, block_bytes), _BLOCK).repartition(width, "block")
    words = blocks.mapInArrow(_explode, "bucket int, block long, words binary")
    encoded = words.groupBy("bucket").applyInArrow(_encode_bucket(vocabulary, pattern), "block long, bucket int, ids binary")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_reassemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes of its ids. Null ids give null; an unknown id fails."""
    spark = encoded.sparkSession
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    bound_batches(spark)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ranks(vocabulary.value)
        length = np.zeros(max(found.values()) + 1, np.int64)
        for token, rank in found.items():
            length[rank] = len(token)
        table = np.frombuffer(b"".join(sorted(found, key=found.get)), np.uint8)
        start = pretokens.offsets(length)
        for batch in batches:
            for part in parts(batch, at, _CHUNK):
                texts = []
                for data in part.column(at):
                    ids = None if data.as_py() is None else np.frombuffer(data.as_py(), "<u4")
                    texts.append(None if ids is None else pretokens.gather(table, start[ids], length[ids]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Digests of every row's ids and of the text decoded from them."""
    found = decode(encode(docs, **options), options.get("ranks_path"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
