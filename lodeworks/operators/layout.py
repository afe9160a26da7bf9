"""Partition layout: sizes, placement by an explicit partition id, co-location.

Defined cases: rows with a null key go to one partition (the first, where the key is placed by number); repeated rows stay
repeated; empty tables have empty partitions, and no largest number of partitions of a key (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, n: int, key: Column) -> DataFrame:
    """df with each row in partition pmod(key, n): the custom partition function."""
    return df.repartitionById(n, F.coalesce(F.pmod(key, F.lit(n)).cast("int"), F.lit(0)))


def at_most(df: DataFrame, n: int) -> DataFrame:
    """df in at most n partitions, without a shuffle."""
    return df.coalesce(n)


def by_key(df: DataFrame, n: int, key: str) -> DataFrame:
    """df in n partitions by the key's hash: rows of a key meet, and a join or aggregation by it needs no further shuffle."""
    return df.repartition(n, key)


def partition_sizes(df: DataFrame, n: int) -> DataFrame:
    """part, n_items of the partitions 0 .. n-1 that df has now, empty ones too. Rows do not move."""
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n_items"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("part"))
    return every.join(sizes, "part", "left").select("part", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))


def most_partitions_of_a_key(df: DataFrame, key: str) -> DataFrame:
    """max_parts: 1 if every key's rows are in one partition."""
    spread = df.select(key, F.spark_partition_id().alias("part")).groupBy(key).agg(F.count_distinct("part").alias("parts"))
    return spread.agg(F.max("parts").alias("max_parts"))


def layout_report(df: DataFrame, key: str, n: int) -> dict:
    """Default and customised layouts: number of partitions and rows in each (one number a partition reaches the driver)."""
    now = df.rdd.getNumPartitions()
    own = place(df, n, F.hash(key))
    return {
        name: {"n_partition": parts, "n_items": [r.n_items for r in partition_sizes(frame, parts).orderBy("part").collect()]}
        for name, frame, parts in (("default", df, now), ("customized", own, n))
    }
