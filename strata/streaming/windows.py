"""Event streams: counts by tumbling windows with a watermark, and the latest event of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder, with the schema of those there now."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_counts(events: DataFrame, length: str, delay: str, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, kind, n): events in each tumbling window; those later than ``delay`` behind the latest seen are dropped, and with them a window's state. Works on tables and streams alike."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs times with a zone: the session's
    late = events.withWatermark(time, delay) if events.isStreaming else events
    counted = late.groupBy(F.window(time, length).alias("w"), F.col(kind)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), kind, "n")


def run_all(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there to Parquet and stop; a later call goes on where this one ended."""
    query = counts.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
