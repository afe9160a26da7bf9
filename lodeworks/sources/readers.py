"""Typed readers of the file formats: JSON lines, delimited pairs and ratings, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEWS = "user_id string, business_id string, stars double, date string"
BUSINESSES = "business_id string, city string, stars double, review_count long"


def json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A malformed line fails the job; so does a row that lacks a required field."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    checks = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a row has no {c}"))).otherwise(F.col(c)) for c in required}
    return df.withColumns(checks) if checks else df


def reviews(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    return json_lines(spark, path, REVIEWS, required)


def businesses(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    return json_lines(spark, path, BUSINESSES, required)


def fields(line: Column) -> Column:
    """Fields of a comma-separated line; quotes have no meaning."""
    return F.split(line, ",", -1)


def delimited(spark: SparkSession, path: str, names: list[str], header: str | None = None) -> DataFrame:
    """Comma-separated lines as string columns. Every line equal to the header is left out.

    header None: the first line of the (first) file is the header, and all lines equal to it go."""
    lines = spark.read.text(path)
    if header is None:
        first = lines.limit(1).first()
        header = first.value if first else ""
    parts = fields(F.col("value"))
    return lines.where(F.col("value") != header).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def pairs(spark: SparkSession, path: str, header: str | None = "user_id,business_id") -> DataFrame:
    return delimited(spark, path, ["user_id", "business_id"], header)


def ratings(spark: SparkSession, path: str, header: str = "user_id, business_id, stars") -> DataFrame:
    """user_id, business_id, stars (null where the file has none)."""
    df = delimited(spark, path, ["user_id", "business_id", "stars"], header)
    return df.withColumn("stars", F.col("stars").cast("double"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """pid, truth, features (array<double>) of header-less numeric lines; the number of features is the line's."""
    parts = fields(F.col("value"))
    return spark.read.text(path).select(
        F.element_at(parts, 1).cast("long").alias("pid"),
        F.element_at(parts, 2).cast("int").alias("truth"),
        F.slice(parts, F.lit(3), F.size(parts) - 2).cast("array<double>").alias("features"),
    )


def with_min_partitions(df: DataFrame, n: int) -> DataFrame:
    """df in at least n partitions."""
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
