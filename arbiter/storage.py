"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir`` or the context's checkpoint
    folder; only local runs without either, as in tests, get one of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="arbiter-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = "file://" + local
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/arbiter/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back.

    This cuts the lineage in a way that survives lost executors, and gives
    later joins a fresh exchange with known size, so that adaptive execution
    can broadcast a small side or split a skewed one. The table stays until
    `release`, since results that were made of it may not have been read yet.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that were made of them can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
