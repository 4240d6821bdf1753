"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of characters outside the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The column as a string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold_case(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder takes its
    place if all runs on one machine, as in tests; on a cluster this is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tallyquill-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


class _Mine(threading.local):
    """Folders that this thread's ``written`` made and that are still there."""

    def __init__(self) -> None:
        self.folders: list[str] = []


_mine = _Mine()


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a read of the files and no earlier stage. The folder
    goes when ``unwritten`` or ``scratch`` says so, else at the end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    place, fs = _store(spark, path)
    fs.deleteOnExit(place)
    df.write.parquet(path)
    _mine.folders.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_at"] = path
    return out


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    if path in _mine.folders:
        _mine.folders.remove(path)
        place, fs = _store(spark, path)
        fs.delete(place, True)


def unwritten(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing will read any more."""
    for df in tables:
        if path := df.__dict__.get("written_at"):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes on leaving what is written inside, but for the tables that the caller puts into the list it gets."""
    before, keep = set(_mine.folders), []
    try:
        yield keep
    finally:
        kept = {df.__dict__.get("written_at") for df in keep}
        for path in [p for p in _mine.folders if p not in before and p not in kept]:
            _delete(spark, path)


def told_apart(docs: DataFrame, id_col: str, row: str) -> tuple[DataFrame, bool]:
    """The rows with a long column ``row`` that tells each from all others, and whether it is the id.

    It is where ids are whole numbers, all there and all different; else each row is given a number,
    once, the rows being written with it.
    """
    if dict(docs.dtypes)[id_col] in ("bigint", "int"):
        seen = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.when(F.col("id").isNull(), 2).otherwise(F.col("n"))).alias("n")).first()
        if (seen["n"] or 0) <= 1:
            return docs.withColumn(row, F.col(id_col).cast("long")), True
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), False


_kept: dict[str, Callable[[], None]] = {}


def keep_only(name: str, clear: Callable[[], None]) -> None:
    """Frees what other operators keep in this Python worker, before operator ``name`` keeps something.

    Workers live through the stages of a pipeline; what they know of words is bounded for one
    operator, not for all of them together.
    """
    others = [x for x in _kept if x != name]
    for other in others:
        _kept.pop(other)()
    if others:  # what was freed goes back to the machine, for the executor's own memory
        gc.collect()
        with suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _kept[name] = clear
