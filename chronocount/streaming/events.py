"""Counts from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``day, user_id, event_type, n`` over tumbling days; works on a stream and on a table alike.

    On a stream a day is given out once the watermark has passed its end, and
    events later than ``late`` are not counted.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null")
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    day = F.window("ts", "1 day")
    return timed.groupBy(day.alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "user_id", "event_type", "n")


def run_daily_counts(spark: SparkSession, source: str, sink: str, checkpoint: str) -> None:
    """Reads what is in the folder ``source`` as a stream and appends finished days to ``sink``; a second run takes up where this one ended."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    query = daily_counts(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
