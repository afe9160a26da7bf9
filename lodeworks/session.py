"""A session with the settings that results rely on: UTC, ANSI arithmetic, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "lodeworks", master: str | None = None, **settings: str) -> SparkSession:
    """An existing session is used as it is; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **settings})
    return (builder.master(master) if master else builder).getOrCreate()
