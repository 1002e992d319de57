"""Contiguous ranges of reads with about equal numbers of bases, and the range that a read is in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.storage import stored

#: The reads are summed in so many steps at most; their sums are what the driver holds.
STEPS = 4096
_READS = 10_000  # a step has about so many at least


def contiguous_ranges(reads: DataFrame, parts: int, steps: int = STEPS) -> DataFrame:
    """part, first, last, n_bases: reads in the order of rid, each part taking reads until the next one would bring it to the mean.

    A part holds a read at least and the last part the rest; parts for which no read is left are missing. The driver holds the
    sums of ``steps`` steps of rids at most and, one after another, the lengths of the reads of the steps in which parts end.
    """
    spark = reads.sparkSession
    lengths = reads.select("rid", F.length("seq").cast("long").alias("len"))
    ends = lengths.agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.sum("len").alias("total"), F.count("*").alias("n")).first()
    found = []
    if ends.low is not None:
        width = -(-(ends.high - ends.low + 1) // min(steps, 1 + ends.n // _READS))
        stepped = lengths.withColumn("step", F.floor((F.col("rid") - ends.low) / width))
        stepped = stored(stepped.repartitionByRange("step", "rid").sortWithinPartitions("step", "rid"), "lengths")
        sums = stepped.groupBy("step").agg(F.sum("len").alias("bases")).orderBy("step").toArrow()  # bounded: steps
        found = _greedy(stepped, sums["step"].to_numpy(), sums["bases"].to_numpy(), ends.total / parts, parts)
    return spark.createDataFrame(found, "part int, first long, last long, n_bases long")


def _greedy(stepped: DataFrame, step: np.ndarray, bases: np.ndarray, mean: float, parts: int) -> list[tuple[int, int, int, int]]:
    upto = np.cumsum(bases)  # of the steps
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def reads_of(i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a step's reads, and the bases up to and with each."""
        if i not in held:
            if len(held) > 2:
                held.clear()
            rows = stepped.where(F.col("step") == int(step[i])).select("rid", "len").orderBy("rid").toArrow()
            held[i] = rows["rid"].to_numpy(), int(upto[i] - bases[i]) + np.cumsum(rows["len"].to_numpy())
        return held[i]

    out, i, at, before = [], 0, 0, 0  # the next part's first read: the at-th of step i, with so many bases before it
    while i < len(step):
        part, first = len(out), int(reads_of(i)[0][at])
        j, k = (i, at + 1) if part < parts - 1 else (len(step), 0)  # a part has its first read whatever its length
        while j < len(step):
            if upto[j] - before < mean:
                j, k = j + 1, 0
                continue
            k += int(np.searchsorted(reads_of(j)[1][k:] - before, mean, "left"))
            if k < len(reads_of(j)[0]):
                break
            j, k = j + 1, 0
        end = int(upto[-1]) if j == len(step) else int(reads_of(j)[1][k - 1]) if k else int(upto[j] - bases[j])
        last = reads_of(j)[0][k - 1] if j < len(step) and k else reads_of(j - 1)[0][-1]
        out.append((part, first, int(last), end - before))
        i, at, before = j, k, end
    return out


def owners(rids: DataFrame, ranges: DataFrame) -> DataFrame:
    """rid, part of the range that holds it; a row for each part is broadcast."""
    return rids.join(F.broadcast(ranges.select("part", "first", "last")), F.col("rid").between(F.col("first"), F.col("last"))).select("rid", "part")
