"""Streams of event files into tables and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> int:
    """Appends the files that are new since the last call to a Parquet table; how many rows came. Exactly once by checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def windowed(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling window; a window closes once the watermark has passed it, rows later than that are dropped."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    out = timed.groupBy(F.window("_time", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "value")

