"""Event streams: an extension, as the grid operators themselves have no streaming form.

Hourly sums by key with a watermark, and the warping cost of finished days
against a reference, both as Structured Streaming queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import dtw


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder of events."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_sums(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """user_id, hour, total, n: tumbling windows of an hour; events later than `late` are dropped by the watermark."""
    wide = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "user_id")
    sums = wide.agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return sums.select("user_id", F.col("w.start").alias("hour"), "total", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n: sessions that a pause longer than gap ends."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_warping(events: DataFrame, reference: list[float], late: str = "2 hours") -> DataFrame:
    """user_id, day, cost: the 24 hourly sums of each day and user against a reference; absent hours are 0."""
    hours = [F.coalesce(F.sum(F.when(F.hour("ts") == h, F.col("value"))), F.lit(0.0)).alias(f"h{h}") for h in range(24)]
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(*hours)
    shaped = days.select("user_id", F.col("w.start").alias("day"), F.array(*(f"h{h}" for h in range(24))).alias("x"), F.array(*(F.lit(float(v)) for v in reference)).alias("y"))
    return shaped.select("user_id", "day", dtw("x", "y").alias("cost"))
