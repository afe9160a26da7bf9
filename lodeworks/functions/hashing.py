"""Linear hashes for MinHash, and dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.storage import stored

MODULUS = 65_537


def coefficients(k: int) -> tuple[int, int]:
    """Multiplier (never a multiple of the modulus) and addend of the k-th hash."""
    return (7919 * k + 13) % (MODULUS - 1) + 1, (104_729 * k + 17) % MODULUS


def linear_hash(index: Column, k: int) -> Column:
    a, b = coefficients(k)
    return (index.cast("long") * F.lit(a).cast("long") + F.lit(b).cast("long")) % MODULUS


def dense_ids(keys: DataFrame, key: str, name: str) -> DataFrame:
    """key and its rank among the distinct keys, from 0; null keys have none, and an empty table gives an empty result.

    Distinct keys are stored, then dealt to ranges and numbered within them as they are written, so that no task sorts all
    keys; a key's id is its place in its range plus the sizes of the ranges before."""
    distinct = stored(keys.select(key).where(F.col(key).isNotNull()).distinct(), "keys")
    ranged = distinct.repartitionByRange(key).sortWithinPartitions(key)
    # Number of the partition above bit 33, place within it below.
    placed = stored(ranged.withColumn("place", F.monotonically_increasing_id()), "ranges")
    placed = placed.select(key, F.shiftright("place", 33).alias("range"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("rank"))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    ahead = sizes.select("range", F.coalesce(before, F.lit(0)).alias("ahead"))
    return placed.join(F.broadcast(ahead), "range").select(key, (F.col("rank") + F.col("ahead")).alias(name))
