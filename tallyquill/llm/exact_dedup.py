"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyquill.llm.common import fold_case, text_of, told_apart, written

#: Ways into which the groups of one digest are dealt before the last combining.
SALTS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id of a group
    stays. Three combining steps each compare whole texts, not digests alone:

    1. within a map task (the partial aggregate), so that a group of any size leaves a task as one row;
    2. by digest, salt and text, the salt being dealt by map task, so that no reducer gets all of a hot group;
    3. by digest and text over the winners of the salts, at most ``salts`` rows a group.

    The rows then find their group by SHA-256, length and a second hash of the text; a hot group is
    a skewed join there, which adaptive execution splits.

    Null text counts as empty. Rows that share an id (repeated rows) are each returned, and stay or
    go together. A null id loses to any other and stays only in a group of null ids. An empty table
    gives no rows. Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), fold_case(text_of(text_col)).alias("norm")).withColumn(
        "text_sha256", F.sha2(F.col("norm"), 256)
    )
    key = ["text_sha256", "n_bytes", "second"]
    hashes = (F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("second"))
    local = base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("text_sha256", "salt", "norm").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("text_sha256", "norm").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = groups.select("text_sha256", *hashes, "keep_id", "group_size")
    rows = base.select("doc_id", "text_sha256", *hashes)
    return rows.join(groups, key).select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with all its columns: the one with the largest id.

    Rows count, not ids: texts that differ each keep a row though their ids are equal, and of rows
    that share id and text one stays. A null id loses to any other. Null texts count as empty ones,
    which are equal. An empty table gives no rows.
    """
    rows, _ = told_apart(docs, id_col, "__row")
    told = rows.select(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("__key"), text_col)
    gone = exact_dedup(told, "__key", text_col).where("not kept").select(F.col("__key.row").alias("__row"))
    gone = written(gone, "copies")  # of known size: broadcast if small, else a shuffled join
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
