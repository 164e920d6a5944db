"""Structured Streaming forms of the incremental aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def windowed(events: DataFrame, width: str, key: str, value: str, late: str = "1 day", time: str = "ts") -> DataFrame:
    """Counts and sums by key in tumbling windows; rows later than the watermark are dropped."""
    stamped = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    grouped = stamped.groupBy(F.window("_ts", width).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n_events", "total")


def running_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """The two sums of which a fraction is made, kept by key; a batch adds to them."""
    return partials.groupBy(*keys).agg(F.sum("weighted").alias("weighted"), F.sum("coverage").alias("coverage")).withColumn("fraction", F.try_divide("weighted", "coverage"))


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 day", time: str = "ts") -> DataFrame:
    stamped = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n_events")


def drained(stream: DataFrame, name: str, mode: str, checkpoint_folder: str) -> DataFrame:
    """All that a stream has to give now, as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
