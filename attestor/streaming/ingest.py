"""Structured Streaming: documents that arrive become chunks once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.chunking import chunk_pages


def ingest_stream(arrivals: DataFrame, chunks_path: str, checkpoint: str, max_chars: int = 1200, overlap: int = 200):
    """Starts a query that chunks each micro-batch of (document_version_id, page_number, text).

    A batch is written to a folder of its own number, which a retried batch overwrites, so chunks are there exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk_pages(batch, max_chars, overlap).write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, chunks_path: str) -> DataFrame:
    return spark.read.parquet(chunks_path)


def activity(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, event_type, n, mean_value)`` in tumbling windows; a stream drops what is later than ``late``."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
