"""Tables written to the folder that driver and executors share, to cut lineage or to feed two consumers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a local session has a folder of its own; a cluster's must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "path" not in _OWN:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _OWN["path"] = tempfile.mkdtemp(prefix="helixspark-", dir="/tmp/checkpoints")
        atexit.register(shutil.rmtree, _OWN["path"], ignore_errors=True)
    return _OWN["path"]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages restart from files, not from lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
