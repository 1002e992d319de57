"""How reads are dealt to tasks. Sources call this; operators leave the layout as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Deal a small table out to all cores, as a read makes as many rows as it has bases; large ones have enough splits.

    Raw rows are to be spread, before anything is computed of them. The size is that of ``like``, if given.
    """
    spark = rows.sparkSession
    size = int(str((like or rows)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if size < cores * (128 << 20) else rows
