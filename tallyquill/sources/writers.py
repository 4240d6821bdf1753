"""Sinks: JSON, markdown, partitioned Parquet."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyquill.functions.text import strip
from tallyquill.operators.tables import context_text


def knowledge_rows(docs: DataFrame, source: str = "tallyquill") -> DataFrame:
    """K2: docs (id, filename, pre, table, post) as knowledge items."""
    content = strip(context_text(F.col("pre"), F.col("table"), F.col("post")))
    return docs.select("id", content.alias("content"), F.struct(F.lit(source).alias("source"), F.col("filename").alias("filename")).alias("metadata"))


def write_json(df: DataFrame, path: str) -> None:
    """K2, K5, K6, K8: a row per line."""
    df.write.mode("overwrite").json(path)


def markdown(id_: Column, pre: Column, table: Column, post: Column) -> Column:
    """K3: sections for what isn't empty, and a rule at the end."""
    section = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), c, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("# "), id_, F.lit("\n\n"), section("Pre-text", pre), section("Table", table), section("Post-text", post), F.lit("---\n"))


def write_markdown(docs: DataFrame, path: str) -> None:
    docs.select(markdown(F.col("id"), F.col("pre"), F.col("table"), F.col("post")).alias("value")).write.mode("overwrite").text(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, a file each task, in the layout that the sources read; an empty task writes an empty array."""

    def lines(batches):
        last = None
        yield pa.RecordBatch.from_arrays([pa.array(["["])], ["value"])
        for b in batches:
            said = [x for x in b.column(0).to_pylist() if x is not None]
            if not said:
                continue
            said, held = [*([last] if last is not None else []), *said], said[-1]
            yield pa.RecordBatch.from_arrays([pa.array([f"{x}," for x in said[:-1]], pa.string())], ["value"])
            last = held
        yield pa.RecordBatch.from_arrays([pa.array([*([last] if last is not None else []), "]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def evaluation_tables(metrics: DataFrame, results: DataFrame, path: str) -> None:
    """K1, at any size: the metrics and the results of the examples, side by side."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    results.write.mode("overwrite").json(f"{path}/example_results")


def evaluation_json(metrics: DataFrame, results: DataFrame, path: str, id_col: str = "example_id") -> None:
    """K1: one JSON object, ``{"metrics": ..., "example_results": [...]}``, the results in order of their ids, which differ.

    It is one file, so one task writes it, row by row; nothing is gathered in memory.
    """
    row = lambda df: F.to_json(F.struct(*df.columns))
    head = metrics.limit(1).select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("key"), F.concat(F.lit('{"metrics": '), row(metrics), F.lit(', "example_results": [')).alias("value"))
    smallest = results.agg(F.min(F.col(id_col).cast("string")).alias("least")).first()["least"]
    comma = F.when(F.col(id_col).cast("string").eqNullSafe(F.lit(smallest)), "").otherwise(", ")
    body = results.select(F.lit(1).alias("part"), F.col(id_col).cast("string").alias("key"), F.concat(comma, row(results)).alias("value"))
    tail = metrics.limit(1).select(F.lit(2).alias("part"), F.lit(None).cast("string").alias("key"), F.lit("]}").alias("value"))
    head.union(body).union(tail).coalesce(1).sortWithinPartitions("part", "key").select("value").write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str) -> None:
    """K4: a folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """K5: df (id, question, output, predicted, answer) as raw, formatted and final files."""
    df.select("id", "output").write.mode("overwrite").json(f"{path}/raw")
    df.select("id", "predicted").write.mode("overwrite").json(f"{path}/formatted")
    df.select(F.struct("id", "question", "answer").alias("qa")).write.mode("overwrite").json(f"{path}/final")


def write_errors(scored: DataFrame, path: str) -> None:
    """K6: the wrong ones apart from all."""
    scored.where("not exe_right").write.mode("overwrite").json(f"{path}/errors")
    scored.write.mode("overwrite").json(f"{path}/all")


def write_collections(nodes: DataFrame, path: str) -> None:
    """K7: text and table nodes as partitions; the context collection is both."""
    nodes.write.mode("overwrite").partitionBy("is_table").parquet(path)


def inspect(df: DataFrame) -> dict:
    """Schema and first row of a prediction file."""
    first = df.limit(1).collect()
    return {"schema": df.schema.simpleString(), "first": first[0].asDict(recursive=True) if first else None}


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """K9: the rows that an experiment tracker would show."""
    return df.limit(n)
