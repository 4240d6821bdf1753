"""Intermediate tables: a branch that several steps read is computed once, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one if all runs on one machine, else an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tallyquill-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def place(spark: SparkSession, path: str):
    """A path and its file system, whichever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing is at yet; what is written there goes at the end of the application."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    at, fs = place(spark, path)
    fs.deleteOnExit(at)
    return path


def once(df: DataFrame, tag: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet and read back.

    What a provider said, or a search found, is neither asked nor searched again by a second reader, and a lost
    executor costs a read of the files. The files go at the end of the application.
    """
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
