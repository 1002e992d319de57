"""Removal of repeated byte strings: every byte under a string of ``window`` bytes that starts more than once goes.

Shards refine the order of their suffixes by themselves, and only what may agree across shards meets:

1. Of each window the gram of 32 bytes with the least hash is its anchor; equal windows have equal anchors. A run of
   windows with one anchor is a segment. Anchors that occur at one place of the corpus end here.
2. Equal segments are counted by name, whatever their number; all windows of a segment that occurs twice are repeated.
3. Different segments with one anchor meet in a bucket; the map tasks that they come from are its shards. Each shard gets
   suffix arrays and their Burrows-Wheeler transforms, and the transforms are merged by refining their interleave (see
   bwt.py), first of phrases cut at places that depend on the bytes, which leaves out segments that share no window with
   another, then of blocks that are compared to the byte. A window is repeated if it lies in an interval of the merge with a
   common prefix of ``window`` bytes.

Only one copy of a segment's bytes leaves a task, and a segment that many rows hold is one row for each task. Anchors
with more different segments than ``bucket_segments`` are not brought together: their windows are counted by name, a hash of
64 bits. A segment's name is one too, beside its anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import bwt
from helixspark.llm.jaccard import _BASE, _INVERSE, _powers, mixed
from helixspark.llm.storage import bound_batches, parts, shuffle_width, stored, trim

WINDOW = 400
GRAM = 32
BUCKET_SEGMENTS = 5_000
_PART_BYTES = 4 << 20
_MEET_BYTES = 1 << 17
_CODES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of any substring of some bytes, from prefix sums of code[byte] * base ** i modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_CODES[data] * _powers(_BASE, self.n), out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * _powers(_INVERSE, self.n + 1)[start] + length.astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = self.n - length + 1
        return mixed((self.sums[length:] - self.sums[:n]) * _powers(_INVERSE, self.n + 1)[:n])


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, from the running minima of blocks in both directions."""
    n = len(values) - width + 1
    blocks = np.concatenate([values, np.full(-len(values) % width, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """First and last window start and anchor hash of each run of windows with the same least gram hash.

    A run longer than a window's number of grams, as in text of a short period, is cut at that length.
    """
    rolling = Rolling(data)
    if len(data) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), rolling
    width = window - gram + 1
    least = window_least(rolling.all(gram), width)
    edge = np.flatnonzero(np.diff(least, prepend=~least[0]))
    if np.diff(edge, append=len(least)).max() > width:
        edge = np.concatenate([np.arange(a, b, width) for a, b in zip(edge, [*edge[1:], len(least)], strict=True)])
    return edge, np.append(edge[1:], len(least)) - 1, least[edge], rolling


def phrase_strings(blobs: list[np.ndarray], rolling: Rolling, offset: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """Each blob as numbers of its phrases, with 0 at the end.

    A phrase begins at each gram whose hash is the least of some ``width`` neighbouring grams. ``width`` is such that a
    window has at least four of these places at which the bytes outside it have no say, so equal windows
    have three phrases in a row in common.
    """
    width = max(1, (window - gram + 3) // 6)
    hashes = rolling.all(gram)
    least = window_least(hashes, width)
    none = np.zeros(width - 1, np.uint64)
    largest = ~window_least(~np.concatenate([none, least, none]), width)  # of the minima of the windows that hold a gram
    begins = largest == hashes
    begins[offset[offset < len(begins)]] = True
    cut = np.union1d(np.flatnonzero(begins), offset)
    names = np.unique(rolling.of(cut, np.diff(cut, append=rolling.n)), return_inverse=True)[1] + 1
    return [np.append(x, 0) for x in np.split(names, np.searchsorted(cut, offset[1:]))]


def block_names(data: np.ndarray, rolling: Rolling, at: np.ndarray, block: int) -> np.ndarray:
    """A number from 1 for the ``block`` bytes at each place, the same for the same bytes: named by hash, then compared with the name's first bearer, to the byte."""
    hashes = rolling.of(at, np.full(len(at), block))
    found, bearer, name = np.unique(hashes, return_index=True, return_inverse=True)
    other = at[bearer][name]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1)).copy().view(np.uint64).ravel() if block >= 8 else padded
    equal = np.ones(len(at), bool)
    for i in [*range(0, block - 7, 8), block - 8] if block >= 8 else range(block):
        equal &= words[at + i] == words[other + i]
    if not equal.all():  # two contents under one hash: by content
        name = np.unique(np.stack([data[at + i] for i in range(block)], axis=1), axis=0, return_inverse=True)[1].ravel()
    return name + 1


def block_size(window: int) -> int:
    """The largest part of a window, an eighth of it at most, of which it is a multiple."""
    return max(b for b in range(1, max(1, window // 8) + 1) if window % b == 0)


def _repeated_blocks(flat: np.ndarray, shard_of: np.ndarray, depth: int) -> np.ndarray:
    """Whether the ``depth`` blocks from each place on stand elsewhere too. A zero ends each string; ``shard_of`` is ascending.

    A block that stands at one place only is in no repeated window, so the strings are cut there, and pieces of less than ``depth``
    blocks go before the merge.
    """
    out = np.zeros(len(flat), bool)
    common = np.bincount(flat) > 1
    common[0] = False
    edge = np.flatnonzero(np.diff(common[flat], prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    start, size = start[size >= depth], size[size >= depth]
    if len(start):
        ends = np.cumsum(size + 1)
        from_ = np.repeat(start - (ends - size - 1), size + 1) + np.arange(ends[-1])  # with the place behind each piece
        pieces = flat[from_]
        pieces[ends - 1] = 0
        whole = np.repeat(ends, size + 1) - np.arange(ends[-1]) > depth  # with ``depth`` blocks before the end
        out[from_[bwt.repeated_places(pieces, size + 1, shard_of[start], depth) & whole]] = True
    return out


def repeated_starts(blobs: list[np.ndarray], window: int, gram: int, shard_of: np.ndarray) -> list[np.ndarray]:
    """Of each blob, whether the window at each start occurs elsewhere in the blobs. ``shard_of`` has each blob's shard, ascending.

    Blobs are merged twice. Of phrases: a blob without three phrases in common with another shares no window and goes. The
    others as blocks: for each of the places 0 to block - 1, the blocks from there on are a string, so that every place of a blob
    begins a suffix of one; suffixes with a common prefix of window / block blocks are equal windows, to the byte.
    """
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    offset, data = np.cumsum(size) - size, np.concatenate(blobs)
    likely = bwt.repeated(phrase_strings(blobs, Rolling(data), offset, window, gram), 8, 3)
    out = [np.zeros(n - window + 1, bool) for n in size.tolist()]
    if not likely.any():
        return out
    which = np.flatnonzero(likely)
    data, size, shard_of = np.concatenate([blobs[i] for i in which]), size[which], shard_of[which]
    offset, block = np.cumsum(size) - size, block_size(window)
    places = size - block + 1
    blob = np.repeat(np.arange(len(which)), places)
    within = np.arange(len(blob)) - np.repeat(np.cumsum(places) - places, places)
    names = block_names(data, Rolling(data), offset[blob] + within, block)
    # the strings of a blob: place % block says which, place // block where in it; 0 ends each
    length = (places[:, None] - np.arange(block) + block - 1) // block + 1
    first = (np.cumsum(length.ravel()) - length.ravel()).reshape(length.shape)
    flat = np.zeros(int(length.sum()), np.int64)
    at = first[blob, within % block] + within // block
    flat[at] = names
    hit = _repeated_blocks(flat, np.repeat(np.repeat(shard_of, block), length.ravel()), window // block)[at]
    starts = np.cumsum(places) - places
    for i, a, n in zip(which.tolist(), starts.tolist(), size.tolist(), strict=True):
        out[i] = hit[a : a + n - window + 1]
    return out


def ranges(hit: np.ndarray) -> list[dict]:
    """Runs of True as first and last place."""
    edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def covered(length: int, starts: list[tuple[int, int]], window: int) -> np.ndarray:
    """Bytes under the windows that start in the ranges."""
    change = np.zeros(length + 1, np.int64)
    for a, b in starts:
        change[a] += 1
        change[b + window] -= 1
    return np.cumsum(change[:-1]) > 0


def anchor_places(data: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor hashes of a text, each as often as it has a place: in text of a short period a run has its anchor at several."""
    anchor, rolling = segments(data, window, gram)[2:]
    if not len(anchor):
        return anchor
    hashes, wanted = rolling.all(gram), np.unique(anchor)
    slots = np.zeros(1 << 16, bool)
    slots[wanted & np.uint64(0xFFFF)] = True
    likely = hashes[slots[hashes & np.uint64(0xFFFF)]]
    return likely[wanted[np.minimum(np.searchsorted(wanted, likely), len(wanted) - 1)] == likely]


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode(), np.uint8)


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2, _PART_BYTES):
                found, places = [], []
                for text in part.column("text"):
                    anchor, count = np.unique(anchor_places(_bytes(text), window, gram).view(np.int64), return_counts=True)
                    found.append(anchor)
                    places.append(count)
                if found:
                    own = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                    yield pa.record_batch([part.column("doc").take(own), part.column("row").take(own), *(pa.array(np.concatenate(x)) for x in (found, places))], names=["doc", "row", "anchor", "places"])

    return run


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SEGMENTS = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("starts", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64()), ("data", pa.binary()), ("shard", pa.int32())])


def _segments(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() if TaskContext.get() else 0
        sent: set[int] = set()  # names of segments whose bytes this task has sent; forgotten when many
        for batch in batches:
            for part in parts(batch, 2, _PART_BYTES):
                rows = []
                for doc, key, text, wanted in zip(part.column("doc").to_pylist(), part.column("row").to_pylist(), part.column("text"), part.column("wanted"), strict=True):
                    data = _bytes(text)
                    first, last, anchor, rolling = segments(data, window, gram)
                    wanted = np.sort(np.array(wanted.as_py(), np.int64))
                    place = np.searchsorted(wanted, anchor.view(np.int64))
                    keep = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == anchor.view(np.int64))
                    size = last[keep] - first[keep] + window
                    names = rolling.of(first[keep], size).view(np.int64)
                    for i, name, n in zip(keep.tolist(), names.tolist(), size.tolist(), strict=True):
                        a = int(first[i])
                        rows.append((doc, key, a, n - window + 1, int(anchor[i : i + 1].view(np.int64)[0]), name, None if name in sent else data[a : a + n].tobytes(), shard))
                        sent.add(name)
                if len(sent) > 500_000:
                    sent.clear()
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENTS, strict=True)], schema=_SEGMENTS)

    return run


def _meet(window: int, gram: int):
    """Sorted by anchor and segment: segments that differ meet, an anchor at a time or many small ones together. The tasks that they come from are the shards."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: r[3] % 8)
        hits = repeated_starts([np.frombuffer(r[2], np.uint8) for r in rows], window, min(16, gram), np.array([r[3] % 8 for r in rows]))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([ranges(h) for h in hits], _RANGES)], names=["anchor", "segment", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for anchor, segment, data, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if rows and rows[-1][:2] == (anchor, segment):
                    continue  # the same segment from another task
                if held >= _MEET_BYTES and rows[-1][0] != anchor:
                    yield resolve(rows)
                    rows, held = [], 0
                rows.append((anchor, segment, data.as_py(), shard))
                held += len(rows[-1][2])
        if rows:
            yield resolve(rows)
        trim()

    return run


def _names(window: int):
    """A row for each window of a segment: its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, segment, data in zip(batch.column("anchor").to_pylist(), batch.column("segment").to_pylist(), batch.column("data"), strict=True):
                names = Rolling(np.frombuffer(data.as_py(), np.uint8)).all(window).view(np.int64)
                n = len(names)
                yield pa.record_batch([pa.array(np.full(n, anchor)), pa.array(np.full(n, segment)), pa.array(np.arange(n)), pa.array(names)], names=["anchor", "segment", "start", "name"])

    return run


def repeated_ranges(texts: DataFrame, window: int, gram: int, bucket_segments: int) -> DataFrame:
    """doc, row, a, b: the windows that start at a..b of the row's text occur more than once. ``texts`` has doc, row and text; doc and row together tell rows apart."""
    bound_batches(texts.sparkSession)
    width = shuffle_width(texts.sparkSession)
    found = stored(texts.mapInArrow(_anchors(window, gram), "doc long, row long, anchor long, places long"), "anchors")
    # from a table, so that Spark can split the rows of an anchor that very many texts have
    shared = stored(found.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1").select("anchor"), "shared")
    wanted = found.join(shared, "anchor", "left_semi").groupBy("doc", "row").agg(F.collect_set("anchor").alias("wanted"))
    held = texts.join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(_segments(window, gram), "doc long, row long, first long, starts long, anchor long, segment long, data binary, shard int")
    held = stored(held, "segments")
    members = held.select("doc", "row", "first", "starts", "anchor", "segment")
    counted = members.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.max("starts").alias("starts"))
    counted = stored(counted, "counted")
    # a lone segment may repeat windows in itself; one that occurs again is covered as a whole
    per_anchor = counted.groupBy("anchor").agg(F.count("*").alias("different"), F.sum("copies").alias("copies")).where("different > 1 OR copies = 1")
    bytes_of = held.where("data IS NOT NULL").select("anchor", "segment", "data", "shard")
    small = bytes_of.join(per_anchor.where(F.col("different") <= bucket_segments).select("anchor"), "anchor", "left_semi")
    met = small.repartition(width, "anchor").sortWithinPartitions("anchor", "segment").mapInArrow(_meet(window, gram), "anchor long, segment long, ranges array<struct<a: long, b: long>>")
    met = met.select("anchor", "segment", F.explode("ranges").alias("r")).select("anchor", "segment", "r.a", "r.b")
    # anchors with very many segments: windows by name, once for each segment and start
    large = bytes_of.join(per_anchor.where(F.col("different") > bucket_segments).select("anchor"), "anchor", "left_semi").mapInArrow(_names(window), "anchor long, segment long, start long, name long")
    large = stored(large, "names").distinct()
    twice = large.groupBy("anchor", "name").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "name")
    named = large.join(twice, ["anchor", "name"], "left_semi").select("anchor", "segment", F.col("start").alias("a"), F.col("start").alias("b"))
    whole = counted.where("copies > 1").select("anchor", "segment", F.lit(0).cast("long").alias("a"), (F.col("starts") - 1).alias("b"))
    parts_ = met.unionByName(named).unionByName(whole)
    return members.join(parts_, ["anchor", "segment"]).select("doc", "row", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_segments: int = BUCKET_SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (first byte and length of the removed runs) and kept.

    Texts are UTF-8 bytes, null is empty; windows lie within one text, and whether a string occurs again is judged on the
    texts as they came. ``kept`` is binary, as a cut may fall within a character. Rows that repeat an id and text
    repeat each other's windows. Other columns are ignored; an empty table gives an empty result.
    """
    key, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(0)).alias("doc"), F.xxhash64(key, text).alias("row"), text.alias("text"))
    starts = repeated_ranges(texts.select("doc", "row", "text"), window, gram, bucket_segments).groupBy("doc", "row").agg(F.collect_set(F.struct("a", "b")).alias("starts"))
    joined = texts.join(starts, ["doc", "row"], "left").select("doc_id", "text", "starts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, _PART_BYTES):
                rows = []
                for doc, text, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                    data = _bytes(text)
                    found = found.as_py()
                    if not found:
                        rows.append((doc, len(data), 0, [], data.tobytes()))
                        continue
                    gone = covered(len(data), [(r["a"], r["b"]) for r in found], window)
                    spans = [{"first": r["a"], "length": r["b"] - r["a"] + 1} for r in ranges(gone)]
                    rows.append((doc, len(data), int(gone.sum()), spans, data[~gone].tobytes()))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<first: long, length: long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as two hexadecimal digits each; windows by a hash of their digits; runs of starts no more than a window apart are one span.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, hash(substr(x, (2 * s + 1)::BIGINT, 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS s FROM d)),
r AS (SELECT doc_id, s, s - lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) > 400 AS head FROM (SELECT doc_id, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1))),
i AS (SELECT doc_id, s, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r),
p AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM i GROUP BY doc_id, span),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM p),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) || substr(any_value(x), (2 * max(b) + 1)::BIGINT) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
