"""Sources: JSON files of one array, dataset folders, vector collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyquill.operators.tables import context_text, format_table, table_text
from tallyquill.sources import schemas
from tallyquill.sources.arrays import read_objects


def read_array(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """The objects of JSON arrays, a file each, read by as many tasks as Spark has splits; a malformed file fails."""
    return read_objects(spark, path, schema, mode).select("item.*")


def read_numbered(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """The objects of JSON arrays with ``seq``, their place in their file from 0, and ``__file``."""
    return read_objects(spark, path, schema, mode).select("item.*", "__file", "seq")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge items, the last one of an id counting."""
    items = read_objects(spark, path, schemas.KNOWLEDGE)
    return items.groupBy(F.col("item.id").alias("__id")).agg(F.max_by("item", F.struct("__file", "seq")).alias("item")).select("item.*")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Dialogues with their place in the file."""
    return read_numbered(spark, path, schemas.DIALOGUE).drop("__file")


def inference_examples(dialogues: DataFrame) -> DataFrame:
    """(id, context, question) from either layout; direct fields win over the annotation, then ``context``."""
    direct = F.col("pre_text").isNotNull() & F.col("post_text").isNotNull() & F.col("table_ori").isNotNull()
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    marked = F.col("annotation").isNotNull()
    context = (
        F.when(direct, context_text(joined("pre_text"), format_table(F.col("table_ori")), joined("post_text")))
        .when(marked, context_text(F.col("annotation.amt_pre_text"), table_text(marked, F.col("annotation.amt_table"), F.col("table"), F.col("table_ori")), F.col("annotation.amt_post_text")))
        .otherwise(F.coalesce(F.col("context"), F.lit("")))
    )
    question = F.coalesce(F.col("qa.question"), F.element_at(F.when(F.size("annotation.dialogue_break") > 0, F.col("annotation.dialogue_break")), -1), F.col("question"), F.lit(""))
    return dialogues.select(F.coalesce("id", F.concat(F.lit("example_"), F.col("seq").cast("string"))).alias("id"), context.alias("context"), question.alias("question"))


def read_split(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """One split of a dataset folder; ``train`` where ``validation`` is asked for and missing."""
    found = spark.read.parquet(folder)
    if split == "validation" and found.where(F.col("split") == split).isEmpty():
        split = "train"
    return found.where(F.col("split") == split).drop("split")


def raw_output(df: DataFrame) -> Column:
    """``output``, else ``prediction``, else ''."""
    columns = [F.col(c) for c in ("output", "prediction") if c in df.columns]
    return F.coalesce(*columns, F.lit(""))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, output); ids by place where the file has none."""
    parsed = read_numbered(spark, path, schemas.PREDICTION, "PERMISSIVE")
    return parsed.select(F.coalesce("id", F.concat(F.lit("example_"), F.col("seq").cast("string"))).alias("id"), raw_output(parsed).alias("output"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_collections(spark: SparkSession, path: str, build=None) -> DataFrame:
    """The stored vector collections; without the complete store they are built again."""
    if build is not None and not exists(spark, f"{path}/_SUCCESS"):
        from tallyquill.sources.writers import write_collections

        write_collections(build(), path)
    return spark.read.parquet(path).withColumn("is_table", F.col("is_table").cast("boolean"))


def collection(nodes: DataFrame, name: str) -> DataFrame:
    """The text, table or context (both) collection; a predicate on the partition column."""
    return {"text": nodes.where("not is_table"), "table": nodes.where("is_table"), "context": nodes}[name]
