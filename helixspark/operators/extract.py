"""Table functions: a read to its k-mers. ``reads`` has rid LONG and seq STRING, normalised."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixspark.config import check_length
from helixspark.functions.arrays import joined, parts
from helixspark.functions.sequence import canonical, checked_codes

#: Bases in one LONG, so that it is never negative and sorts as the text.
WORD = 31
_SLICE = 1 << 20  # bases handled at a time
_BIN_BITS = 18
#: Bins of k-mers, whose totals bound the counts in them.
BINS = 1 << _BIN_BITS


def long_enough(reads: DataFrame, k: int) -> DataFrame:
    return reads.where(F.length("seq") >= k)


def kmers(reads: DataFrame, k: int, name: str = "kmer") -> DataFrame:
    """rid, pos and the forward k-mer of every window; reads shorter than k have none."""
    check_length(name, k)
    # the filter on the start comes after, as one on the sequence would be computed anew below whatever made the sequence
    starts = F.explode_outer(F.sequence(F.lit(0), F.greatest(F.length("seq") - k, F.lit(0)))).alias("pos")
    rows = reads.select("rid", "seq", starts).where(F.col("pos") + k <= F.length("seq"))
    return rows.select("rid", "pos", F.substr("seq", F.col("pos") + 1, F.lit(k)).alias(name))


def canonical_kmers(reads: DataFrame, k: int, name: str = "kmer") -> DataFrame:
    return kmers(reads, k, name).withColumn(name, canonical(F.col(name)))


def mmers(reads: DataFrame, m: int) -> DataFrame:
    return kmers(reads, m, "mmer")


def canonical_mmers(reads: DataFrame, m: int) -> DataFrame:
    return canonical_kmers(reads, m, "mmer")


def mmer_text(mmer: Column) -> Column:
    """An m-mer as it is printed."""
    return F.concat(F.lit("M-mer("), mmer, F.lit(")"))


def word_columns(k: int) -> list[str]:
    return [f"w{i}" for i in range(-(-k // WORD))]


def packed_windows(codes: np.ndarray, k: int, word: int = WORD) -> np.ndarray:
    """Packed words (of up to ``word`` bases) of every window of k base codes, by doubling the width: shape (windows, words), uint64."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros((0, -(-k // word)), np.uint64)
    widths = {1: codes.astype(np.uint64)}
    w = 1
    while 2 * w <= min(k, word):
        a = widths[w]
        widths[2 * w] = (a[: len(a) - w] << np.uint64(2 * w)) | a[w:]
        w *= 2

    def of(start: int, size: int) -> np.ndarray:
        out, done = None, 0
        for w in sorted(widths, reverse=True):
            while size - done >= w:
                more = widths[w][start + done : start + done + n]
                out = more if out is None else (out << np.uint64(2 * w)) | more
                done += w
        return out

    return np.stack([of(a, min(word, k - a)) for a in range(0, k, word)], axis=1)


def canonical_windows(codes: np.ndarray, k: int, word: int = WORD) -> np.ndarray:
    """As packed_windows, of the lesser of each window and its reverse complement."""
    forward = packed_windows(codes, k, word)
    back = packed_windows((3 - codes)[::-1], k, word)[::-1]
    if forward.shape[1] == 1:
        return np.minimum(forward, back)
    less, open_ = np.zeros(len(forward), bool), np.ones(len(forward), bool)
    for i in range(forward.shape[1]):
        less |= open_ & (back[:, i] < forward[:, i])
        open_ &= back[:, i] == forward[:, i]
    return np.where(less[:, None], back, forward)


def _grouped(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, where equal ones begin in it, and how many are equal."""
    order = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort(words.T[::-1])
    ordered = words[order]
    begin = np.flatnonzero(np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))[: len(ordered)])
    return order, begin, np.diff(begin, append=len(ordered))


def slices(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Base codes of a batch of reads in pieces of bounded length that overlap by k - 1 bases, so that every window is in one.

    With each piece: the starts in it of windows that lie within one read, and the row and position of these.
    """
    text, offsets = joined(column)
    codes = checked_codes(text, offsets)
    row = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(offsets))
    for a in range(0, len(codes) - k + 1, _SLICE):
        piece = codes[a : a + _SLICE + k - 1]
        own = row[a : a + len(piece) - k + 1]
        start = np.flatnonzero(own == row[a + k - 1 : a + len(piece)])
        if len(start):
            yield piece, start, own[start], start + a - offsets[own[start]]


def _word_arrays(words: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(words.shape[1])]


def bins_of(words: np.ndarray) -> np.ndarray:
    """A number from 0 to BINS - 1 for each row of packed words, the same for the same words."""
    mixed = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        mixed = (mixed ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BIN_BITS)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], k: int, kept: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Packed words of the canonical windows, about a million at a time; with ``kept``, of those in the bins that it marks."""
    held, size = [], 0
    for batch in batches:
        for codes, start, _, _ in slices(batch.column(0), k):
            words = canonical_windows(codes, k)[start]
            if kept is not None:
                words = words[kept[bins_of(words)]]
            if len(words):
                held.append(words)
                size += len(words)
            if size >= _SLICE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def packed_counts(reads: DataFrame, k: int, kept: np.ndarray | None = None) -> DataFrame:
    """Partial counts of canonical k-mers, as packed words, combined within about a million windows. Reads shorter than k have none.

    With ``kept``, a boolean for each bin, only k-mers of these bins are counted, each in full.
    """
    check_length("k", k)
    names = word_columns(k)
    schema = T.StructType([T.StructField(c, T.LongType(), False) for c in [*names, "cnt"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _gathered(batches, k, kept):
            order, begin, count = _grouped(words)
            yield pa.record_batch([*_word_arrays(words[order[begin]]), pa.array(count)], names=[*names, "cnt"])

    return reads.select("seq").mapInArrow(run, schema)


def count_bounds(reads: DataFrame, k: int, n: int) -> DataFrame:
    """bin, packed words, cnt: what bounds the counts of canonical k-mers from both sides, before any is sent.

    Rows with a bin have the occurrences of all its k-mers, so no k-mer of it has more. Rows without have a k-mer and at least some of its
    occurrences, from the tasks where it was among the most frequent, so it has no fewer.
    """
    check_length("k", k)
    names = word_columns(k)
    schema = T.StructType([T.StructField("bin", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in [*names, "cnt"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        top, times = np.zeros((0, len(names)), np.uint64), np.zeros(0, np.int64)
        for words in _gathered(batches, k):
            total += np.bincount(bins_of(words), minlength=BINS)
            order, begin, count = _grouped(words)
            first = np.argsort(-count, kind="stable")[: 4 * n]
            both, counts = np.concatenate([top, words[order[begin[first]]]]), np.concatenate([times, count[first]])
            order, begin, _ = _grouped(both)
            sums = np.add.reduceat(counts[order], begin)
            first = np.argsort(-sums, kind="stable")[: 4 * n]
            top, times = both[order[begin[first]]], sums[first]
        found = np.flatnonzero(total)
        if len(found):
            nothing = [pa.nulls(len(found), pa.int64())] * len(names)
            yield pa.record_batch([pa.array(found, pa.int32()), *nothing, pa.array(total[found])], names=["bin", *names, "cnt"])
            yield pa.record_batch([pa.nulls(len(top), pa.int32()), *_word_arrays(top), pa.array(times)], names=["bin", *names, "cnt"])

    return reads.select("seq").mapInArrow(run, schema).groupBy("bin", *names).agg(F.sum("cnt").alias("cnt"))


def packed_occurrences(reads: DataFrame, k: int, max_count: int | None = None) -> DataFrame:
    """rid, pos and the packed words of every canonical k-mer.

    A k-mer that occurs more than ``max_count`` times within about a million windows does so in all reads too: its
    occurrences are not sent, so that a k-mer that is everywhere does not fill the task of its key.
    """
    check_length("k", k)
    names = word_columns(k)
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("pos", T.IntegerType()), *(T.StructField(c, T.LongType(), False) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0)
            for codes, start, row, pos in slices(batch.column(1), k):
                words = canonical_windows(codes, k)[start]
                if max_count is not None:
                    order, _, count = _grouped(words)
                    keep = np.sort(order[np.repeat(count <= max_count, count)])
                    words, row, pos = words[keep], row[keep], pos[keep]
                yield pa.record_batch([rids.take(pa.array(row)), pa.array(pos, pa.int32()), *_word_arrays(words)], names=["rid", "pos", *names])

    return reads.select("rid", "seq").mapInArrow(run, schema)


def window_sums(reads: DataFrame, k: int, values: Callable[[np.ndarray, np.ndarray], np.ndarray], sums: dict[str, tuple[np.ufunc, Callable[[str], Column]]]) -> DataFrame:
    """rid, n and ``sums`` over each read's windows of k bases: their number, and a LONG of every window put together.

    ``values`` gives the LONGs of the windows that begin at some places of a piece of base codes; a sum is named by how numpy and Spark put two together.
    A task sums up what it holds of a read, so that windows never become rows; pieces of a read, and rows that repeat a rid, are put together
    after that. Reads shorter than k have no row.
    """
    check_length("k", k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in parts(batch, "seq", _SLICE)):
            for codes, start, row, _ in slices(part.column("seq"), k):
                found = values(codes, start)
                begin = np.flatnonzero(np.diff(row, prepend=-1))
                columns = [part.column("rid").take(pa.array(row[begin])), pa.array(np.diff(begin, append=len(row)))]
                yield pa.record_batch([*columns, *(pa.array(of.reduceat(found, begin)) for of, _ in sums.values())], names=["rid", "n", *sums])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ["rid", "n", *sums]])
    found = reads.select("rid", "seq").mapInArrow(run, schema).groupBy("rid")
    return found.agg(F.sum("n").alias("n"), *(of(c).alias(c) for c, (_, of) in sums.items()))


def unpacked(k: int) -> Column:
    """The text of packed words."""
    parts = []
    for i, name in enumerate(word_columns(k)):
        size = min(WORD, k - i * WORD)
        parts.append(F.translate(F.lpad(F.conv(F.col(name).cast("string"), 10, 4), size, "0"), "0123", "ACGT"))
    return F.concat(*parts)
