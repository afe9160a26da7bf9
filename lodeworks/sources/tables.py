"""The test tables in the roles that the operators expect: ratings, baskets, features, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.profile import normalised
from lodeworks.operators.recommend import dedupe
from lodeworks.storage import table


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, l_partkey, l_suppkey, l_orderkey, l_quantity: lines of orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey")


def _rated(rows: DataFrame) -> DataFrame:
    return dedupe(rows.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), (1.0 + F.col("l_quantity") % 5).alias("stars")))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, stars."""
    return _rated(purchases(spark, sf_dir))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of nine tenths of the orders; some users and some items have none, so that fallbacks are met."""
    return _rated(purchases(spark, sf_dir).where("l_orderkey % 10 <> 0 and o_custkey % 50 <> 0 and l_partkey % 40 <> 0"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, stars of the other orders."""
    return _rated(purchases(spark, sf_dir).where("l_orderkey % 10 = 0"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, stars, norm_stars, norm_count; some items have none."""
    part = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0")
    rows = part.select(F.col("p_partkey").alias("item"), (1.0 + F.col("p_size") % 5).alias("stars"), F.col("p_size").cast("long").alias("review_count"))
    return normalised(rows, "stars", "review_count").select("item", "stars", "norm_stars", "norm_count")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, truth, features."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("pid"), F.col("label").alias("truth"), F.col("embedding").cast("array<double>").alias("features"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, truth (event type), features (value, k, hour) of events."""
    rows = table(spark, sf_dir, "events")
    k = F.from_json("props", "k double")["k"]
    parts = F.array(F.col("value"), F.coalesce(k, F.lit(0.0)), F.hour("ts").cast("double"))
    return rows.select(F.col("event_id").alias("pid"), F.col("event_type").alias("truth"), parts.alias("features"))
