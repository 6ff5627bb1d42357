"""Extensions on Structured Streaming: a lexical index that follows new files, and event counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators.index import term_counts


def follow_postings(new_rows: DataFrame, key: str, text: str, folder: str, checkpoint: str):
    """Appends postings of each batch under its number, so a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        term_counts(batch, key, text).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return new_rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type, late ones up to ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
