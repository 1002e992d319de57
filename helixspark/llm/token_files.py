"""Token-id files: ids of a corpus in document order, each shard a Re-Pair grammar.

The files are Parquet tables written by Spark, one row per shard: the shard's place in the order, its documents, their
token counts, and the grammar of all their ids. Shards follow each other in ascending document id, so a
document's start is the sum of the shards before it and of the documents before it in its own shard.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.llm import pretokens
from helixspark.llm.repair import Grammar, compressed
from helixspark.llm.storage import bound_batches, new_path, shuffle_width, trim

TOKENIZER = "byte_bpe_50k.json"
SHARD_TOKENS = 2_000_000
_SHARDS = "part int, shard int, n_tokens long, docs array<long>, counts array<long>, grammar binary"
KNOWN_WORDS = 2_000_000
_MARK = chr(0xE000)
_ENCODERS: dict[tuple, Encoder] = {}  # of this Python worker, by the vocabulary's checksum, the end id and how special tokens are read


class Encoder:
    """Numbers words and holds the ids of those it has met; at most about ``KNOWN_WORDS`` of them.

    Where a special token's string stands in a text, it is that token, as the library has it, and the text on either side is
    cut into words by itself; with ``special_as_text`` it is text like any other.
    """

    def __init__(self, vocabulary: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task: the cores have tasks of their own
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        # words are pre-tokens already; many are encoded in one call, parted by a mark
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(_MARK, "removed"), byte_level])
        self.single = Tokenizer.from_str(vocabulary)
        self.single.encode_special_tokens = special_as_text
        added = [] if special_as_text else [*self.single.get_added_tokens_decoder().values()]
        if odd := [t.content for t in added if t.lstrip or t.rstrip or t.single_word]:
            raise ValueError(f"special tokens that depend on what stands beside them: {odd}")
        self.special = {t.content for t in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.split = pretokens.splitter()
        self.base = self.tokenizer.get_vocab_size()
        self.clear()

    def clear(self) -> None:
        self.words, self.starts, self.lengths, self.ids = pretokens.Numbering(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.words[""] = 0  # no pre-token is empty; the number stands for the end of a document
        self.done = self.filled = 0

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's words and special tokens; no word is the string of a special token."""
        if self.marks is None or not self.marks.search(text):
            return self.words.of(text, self.split)
        parts = self.marks.split(text)  # every other one is a token
        found = [self.words.of(x, self.split) if i % 2 == 0 else np.array([self.words[x]], np.uint32) for i, x in enumerate(parts)]
        return np.concatenate(found)

    def update(self, end_ids: list[int]) -> None:
        """Encode the words that are new; ``starts`` and ``lengths`` then place every word's ids in ``ids``."""
        new = list(islice(self.words, self.done, None))
        ids, lengths = array("I"), array("I")
        if not self.done:
            new.pop(0)
            ids.extend(end_ids)
            lengths.append(len(end_ids))
        for a in range(0, len(new), 1_000):
            joined = _MARK.join(words := new[a : a + 1_000])
            if joined.count(_MARK) != len(words) - 1 or not self.special.isdisjoint(words):
                for found in self.single.encode_batch(words, add_special_tokens=False):
                    ids.extend(found.ids)
                    lengths.append(len(found))
                continue
            found = self.tokenizer.encode(joined, add_special_tokens=False)
            ids.extend(found.ids)
            lengths.extend(np.bincount(found.word_ids, minlength=len(words)).tolist())
        size = np.array(lengths, np.int64)
        self.starts = _appended(self.starts, self.done, self.filled + pretokens.offsets(size))
        self.lengths = _appended(self.lengths, self.done, size)
        self.ids = _appended(self.ids, self.filled, np.array(ids, np.uint32))
        self.done, self.filled = len(self.words), self.filled + len(ids)


def _appended(room: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``room`` with ``more`` behind its first ``used`` elements; it doubles when it is full."""
    if used + len(more) > len(room):
        room = np.concatenate([room[:used], np.zeros(max(used, len(more), 1 << 16) + len(more), room.dtype)])
    room[used : used + len(more)] = more
    return room


def encoder(vocabulary: str, end_id: int | None, special_as_text: bool) -> Encoder:
    key = (zlib.crc32(vocabulary.encode()), end_id, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, special_as_text)
    return _ENCODERS[key]


def shards(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int | None, shard_tokens: int, special_as_text: bool = False) -> Iterator[pa.RecordBatch]:
    known = encoder(vocabulary, end_id, special_as_text)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    end_ids = [] if end_id is None else [end_id]
    end = np.zeros(1, np.uint32)  # the number of the end of a document
    docs, sequences, held, made = [], [], 0, 0

    def shard() -> pa.RecordBatch:
        known.update(end_ids)
        numbers = np.concatenate([x for s in sequences for x in (s, end)])
        sizes = known.lengths[numbers]
        ids = pretokens.gather(known.ids, known.starts[numbers], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *(len(s) + 1 for s in sequences)])]
        row = {"part": pa.array([part], pa.int32()), "shard": pa.array([made], pa.int32()), "n_tokens": [len(ids)], "docs": pa.array([docs], pa.list_(pa.int64())), "counts": pa.array([np.diff(ends)], pa.list_(pa.int64())), "grammar": [compressed(ids, known.base).to_bytes()]}
        if len(known.words) > KNOWN_WORDS:
            known.clear()
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs.append(doc)
            sequences.append(known.numbers(text.as_py() or ""))
            held += len(sequences[-1]) + 1
            if held >= shard_tokens:
                yield shard()
                docs, sequences, held, made = [], [], 0, made + 1
                trim()
    if docs:
        yield shard()
    trim()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, special_as_text: bool = False) -> None:
    """Encode every text whole, append ``end_id`` if it is given, and write the ids in ascending document id.

    A null text is empty: its only id is the end id. Null ids come first; rows that repeat an id stand together,
    ordered by text. Other columns are ignored. An empty table gives no shard. Shards close at the first document
    end after ``shard_tokens`` pre-tokens, so a very long text is one shard. Strings of special tokens are these tokens, unless
    ``special_as_text``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # bounded: a vocabulary, not data
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ordered = texts.repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: shards(batches, vocabulary.value, end_id, shard_tokens, special_as_text), _SHARDS).write.parquet(path)


def _decoded(shards: DataFrame, schema: str, describe) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard, docs, counts = (batch.column(c)[row].as_py() for c in ("part", "shard", "docs", "counts"))
                ids = Grammar.from_bytes(batch.column("grammar")[row].as_py()).ids().astype("<u4")
                starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                values = [describe(ids[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(values, *([pa.binary()] if schema == "binary" else [pa.int64()]))], names=["part", "shard", "doc_id", "within", "n_tokens", "value"])
        trim()

    return shards.mapInArrow(run, f"part int, shard int, doc_id long, within long, n_tokens long, value {schema}")


def _placed(spark: SparkSession, path: str, schema: str, describe) -> DataFrame:
    shards = spark.read.schema(_SHARDS).parquet(path)
    # a few numbers a shard of millions of tokens: the only thing that is summed in one task
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    return _decoded(shards, schema, describe).join(before, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "value")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32) of each document in the files."""
    return _placed(spark, path, "binary", lambda ids: ids.tobytes()).withColumnRenamed("value", "ids")


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files."""
    return _placed(spark, path, "long", lambda ids: zlib.crc32(ids.tobytes())).withColumnRenamed("value", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_checksums(spark, path)
