"""Streaming ingestion (an extension): the batch functions over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyquill.operators.chunks import annotate, word_chunks


def stream_documents(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def chunked(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks with their numbers; stateless, so no watermark is needed."""
    return annotate(word_chunks(docs, size=size, overlap=overlap))


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Processes what is there and stops; exactly once through the sink's log and the checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
