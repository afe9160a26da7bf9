"""Profiles of review streams: the batch profile's counts, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources.readers import REVIEWS


def review_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """JSON-lines files of a folder, as they come."""
    reader = spark.readStream.schema(REVIEWS).option("mode", "FAILFAST")
    return (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).json(path)


def key_counts(stream: DataFrame, key: str) -> DataFrame:
    """key, n so far. State is one row a key."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, key: str, time: str, width: str, late: str) -> DataFrame:
    """start, key, n of tumbling windows; rows later than ``late`` behind the newest are left out, and closed windows leave the state."""
    marked = stream.withColumn("at", F.to_timestamp(time)).withWatermark("at", late)
    return marked.groupBy(F.window("at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
