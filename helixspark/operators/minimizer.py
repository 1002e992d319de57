"""Minimizers, their tasks, and supermers.

A k-mer's minimizer is the least hash (unsigned) of the canonical m-mers in it. Its task is that hash modulo the
number of tasks, so all copies of a canonical k-mer are in one task. A supermer is a run of neighbouring k-mers of one
task, cut after ``max_len - k + 1`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.functions.arrays import joined, parts, pieces, rows_of
from helixspark.functions.hashing import murmur64, murmur128
from helixspark.functions.sequence import canonical, supermer_bytes
from helixspark.operators.extract import canonical_windows, slices

_SIGN = -(1 << 63)
_PART_BASES = 1 << 20


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, from the running minima of blocks in both directions."""
    n = len(values) - width + 1
    top = np.iinfo(values.dtype).max
    blocks = np.concatenate([values, np.full(-len(values) % width, top, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def mmer_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """Hash of every window's canonical m-mer."""
    return murmur64(hash_words(codes, m))


def hash_words(codes: np.ndarray, m: int, windows: Callable = canonical_windows) -> np.ndarray:
    """The canonical m-mers (or other ``windows``) as they are hashed: 32 bases a word, from the high bits."""
    words = windows(codes, m, 32)
    words[:, -1] <<= np.uint64(64 - 2 * (m - 32 * (words.shape[1] - 1)))
    return words


def _minima(column: pa.Array, k: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, position and minimizer of the k-mers of a batch of reads, in slices of bounded memory."""
    for codes, start, row, pos in slices(column, k):
        yield row, pos, window_minima(mmer_hashes(codes, m), k - m + 1)[start]


def read_minimizers(seq: str, k: int, m: int) -> np.ndarray:
    """The minimizer hash of every k-mer of a read."""
    return np.concatenate([np.zeros(0, np.uint64), *(found for _, _, found in _minima(pa.array([seq]), k, m))])


def minimizers(reads: DataFrame, k: int, m: int) -> DataFrame:
    """rid, pos, minimizer: the LONG with the bits of the unsigned hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pos, found in _minima(batch.column("seq"), k, m):
                yield pa.record_batch([batch.column("rid").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(found.view(np.int64))], names=["rid", "pos", "minimizer"])

    return reads.select("rid", "seq").mapInArrow(run, "rid long, pos int, minimizer long")


def unsigned(value: Column) -> Column:
    """An order-keeping LONG for an unsigned 64-bit pattern."""
    return value.bitwiseXOR(F.lit(_SIGN))


def task_of(minimizer: Column, tasks: int) -> Column:
    """Unsigned remainder, from the upper 63 bits and the lowest."""
    half = F.shiftrightunsigned(minimizer, 1)
    low = minimizer.bitwiseAND(F.lit(1))
    return ((half % tasks) * 2 + low) % tasks


def minimizer_tasks(reads: DataFrame, k: int, m: int, tasks: int) -> DataFrame:
    """rid, pos, task."""
    return minimizers(reads, k, m).select("rid", "pos", task_of(F.col("minimizer"), tasks).cast("int").alias("task"))


def supermers(reads: DataFrame, k: int, m: int, tasks: int, max_len: int = 250) -> DataFrame:
    """rid, pos, len, task, seq: pos is the first base, len counts bases."""
    if max_len < k:
        raise ValueError("max_len must be at least k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "seq", _PART_BASES):
                text, offsets = joined(part.column("seq"))
                # the last run of a slice may go on in the next one
                row, pos, task = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
                for more_row, more_pos, found in _minima(part.column("seq"), k, m):
                    row, pos = np.append(row, more_row), np.append(pos, more_pos)
                    task = np.append(task, (found % np.uint64(tasks)).astype(np.int32))
                    starts = _starts(row, task, max_len - k + 1)
                    yield cut(part, text, offsets, row, pos, task, starts)
                    row, pos, task = (x[starts[-1] :] for x in (row, pos, task))
                if len(row):
                    yield cut(part, text, offsets, row, pos, task, np.array([0, len(row)]))

    def cut(part, text, offsets, row, pos, task, starts) -> pa.RecordBatch:
        first = starts[:-1]
        length = np.diff(starts) + k - 1
        seq = rows_of(*pieces(text, offsets[row[first]] + pos[first], length), pa.string())
        return pa.record_batch([part.column("rid").take(pa.array(row[first])), pa.array(pos[first], pa.int32()), pa.array(length, pa.int32()), pa.array(task[first]), seq], names=["rid", "pos", "len", "task", "seq"])

    return reads.select("rid", "seq").mapInArrow(run, "rid long, pos int, len int, task int, seq string")


def _starts(row: np.ndarray, task: np.ndarray, most: int) -> np.ndarray:
    """Where runs of one read and task begin; a long run begins anew after ``most`` k-mers."""
    edge = np.flatnonzero(np.append(True, (task[1:] != task[:-1]) | (row[1:] != row[:-1])))
    length = np.diff(edge, append=len(task))
    each = -(-length // most)
    within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return np.repeat(edge, each) + within * most


def supermer_kmers(found: DataFrame, k: int) -> DataFrame:
    """rid, pos, kmer: the canonical k-mers of supermers, placed in their reads."""
    rows = found.select("rid", "pos", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("i"))
    return rows.select("rid", (F.col("pos") + F.col("i")).alias("pos"), canonical(F.substr("seq", F.col("i") + 1, F.lit(k))).alias("kmer"))


def task_sizes(found: DataFrame, k: int) -> DataFrame:
    """task, n_kmers, n_supermers of supermers; tasks without any are left out."""
    return found.groupBy("task").agg(F.sum(F.col("len") - (k - 1)).cast("long").alias("n_kmers"), F.count("*").alias("n_supermers"))


def heavy_tasks(sizes: DataFrame, tasks: int, ratio: float = 2.3) -> DataFrame:
    """task, n_kmers, heavy: above ``ratio`` times the mean over all tasks, the empty ones included."""
    total = sizes.agg(F.sum("n_kmers").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("task", "n_kmers", (F.col("n_kmers") * tasks > ratio * F.col("total")).alias("heavy"))


def round_robin(sizes: DataFrame, workers: int) -> DataFrame:
    """task, worker."""
    return sizes.select("task", F.pmod("task", F.lit(workers)).cast("int").alias("worker"))


def task_bytes(found: DataFrame) -> DataFrame:
    """task, n_bytes: what the supermers of a task take on the wire, each with four bytes for its length."""
    return found.groupBy("task").agg(F.sum(supermer_bytes(F.col("len")) + 4).cast("long").alias("n_bytes"))


def balanced(sizes: DataFrame, workers: int, size_col: str = "n_bytes", weight_col: str | None = None, limit: float = 1.5, step: float = 0.05) -> DataFrame:
    """task, worker: an assignment of a bounded number of tasks (a row for each comes to the driver) under a multiple of the mean load.

    The largest tasks go one to a worker, from the first on. The others, from small to large (ties: by task), go in turn
    to the next worker, from the last back to the first, that has room for their size; what they add to its load is their size times
    their weight. The multiple starts at 1 - ``step`` and grows by ``step``; if it would reach ``limit``, there is no assignment.
    """
    weight = F.lit(1) if weight_col is None else F.col(weight_col)
    rows = sizes.select("task", F.col(size_col).cast("long").alias("size"), weight.cast("long").alias("weight")).orderBy("size", "task").collect()
    placed = _assignment([tuple(r) for r in rows], workers, limit, step)
    return sizes.sparkSession.createDataFrame(sorted(placed.items()), "task int, worker int")


def _assignment(order: list[tuple[int, int, int]], workers: int, limit: float, step: float) -> dict[int, int]:
    mean, tries = sum(size for _, size, _ in order) // workers, 1
    head, rest = order[::-1][:workers], order[: max(0, len(order) - workers)]
    while (multiple := 1 + (tries - 2) * step) < limit - 1e-9:
        tries += 1
        load, place, at = [0] * workers, {}, workers - 1
        for worker, (task, size, weight) in enumerate(head):
            place[task], load[worker] = worker, size * weight
        for task, size, weight in rest:
            turn = next((t for t in range(workers) if load[(at - t) % workers] + size <= int(mean * multiple)), None)
            if turn is None:
                break
            worker = (at - turn) % workers
            place[task], load[worker], at = worker, load[worker] + size * weight, (worker - 1) % workers
        else:
            return place
    raise ValueError(f"no assignment of {len(order)} tasks to {workers} workers stays under {limit} times the mean")


def hash_owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Of equal ranges of the unsigned 64-bit numbers, the one that holds each hash: floor(hash * owners / 2 ** 64)."""
    low = (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(owners) >> np.uint64(32)
    return ((hashes >> np.uint64(32)) * np.uint64(owners) + low >> np.uint64(32)).astype(np.int32)


def kmer_hashes(reads: DataFrame, k: int, owners: int) -> DataFrame:
    """rid, pos of every k-mer, both halves of its canonical form's hash (hash, second, as LONGs with their bits), its low 32 bits (low), and the owner of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, start, row, pos in slices(batch.column("seq"), k):
                one, two = murmur128(hash_words(codes, k)[start])
                yield pa.record_batch([batch.column("rid").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array((one & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(hash_owner(one, owners))], names=["rid", "pos", "hash", "second", "low", "owner"])

    return reads.select("rid", "seq").mapInArrow(run, "rid long, pos int, hash long, second long, low long, owner int")
