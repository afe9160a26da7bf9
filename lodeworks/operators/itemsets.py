"""Baskets and frequent itemsets.

Defined cases: a null basket is a basket like any other where baskets are built, and null items play no part; repeated rows make
no second item; a support that no set reaches, and an empty table, give an empty result; items of equal counts are
ordered by name; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import dense_ids
from lodeworks.functions.pairing import paired
from lodeworks.storage import BROADCAST_ROWS, bounded, remove, stored


def baskets(df: DataFrame, basket: str, item: str, more_than: int | None = None) -> DataFrame:
    """basket, items (sorted, distinct). more_than: only baskets with more rows than that, repeats included."""
    grouped = df.groupBy(F.col(basket).alias("basket")).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"), F.count(F.lit(1)).alias("n"))
    return (grouped if more_than is None else grouped.where(F.col("n") > more_than)).select("basket", "items")


def frequent_itemsets(found: DataFrame, support: int) -> DataFrame:
    """items, freq of every itemset in at least ``support`` baskets, level by level."""
    return _levels(found.withColumn("part", F.lit(0)), float(support)).select("items", F.col("n").alias("freq"))


def fp_growth(found: DataFrame, support: int) -> DataFrame:
    """The same by FP-growth, which shards conditional trees by item: for long itemsets.

    Items and pairs are counted first, a range of items at a time (paired()); trees are grown from the items of frequent pairs alone, as
    the others are in no longer set. Its threshold is a share that is turned into a rounded-up count; half a basket less keeps
    rounding from moving it."""
    found = stored(found.select(F.monotonically_increasing_id().alias("basket"), "items"), "baskets")
    rows = found.select("basket", F.explode("items").alias("item")).where(F.col("item").isNotNull())
    single = stored(rows.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= support), "single")
    out = single.select(F.array("item").alias("items"), "freq")
    names = stored(dense_ids(single, "item", "code").select("item", F.col("code").cast("int").alias("code")), "names")
    coded = stored(rows.join(bounded(names, ("item",)), "item").select("basket", "code"), "coded")
    pairs = stored(paired(coded, "basket", "code", [], F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= support), "pairs")
    remove(coded)
    if pairs.isEmpty():
        return out
    useful = names.join(pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct(), "code", "left_semi")
    kept = rows.join(bounded(useful, ("item",)), "item").groupBy("basket").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1)
    kept = stored(kept, "kept")
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / kept.count())).fit(kept)
    longer = model.freqItemsets.where(F.size("items") > 1)
    return out.unionByName(longer.select(F.array_sort("items").alias("items"), "freq"))


def local_frequent(found: DataFrame, support: int, parts: int, part: F.Column | None = None) -> DataFrame:
    """Candidates: itemsets whose count within a part of the baskets reaches support / parts.

    A part is pmod(basket, parts), or the given column."""
    by = F.pmod(F.col("basket"), F.lit(parts)) if part is None else part
    return _levels(found.withColumn("part", by.cast("int")), support / parts).select("items").distinct()


def _levels(found: DataFrame, least: float) -> DataFrame:
    """part, items, n of the itemsets that at least ``least`` baskets of a part hold.

    Items and frequent sets travel as numbers that keep the items' order. An occurrence (basket, head, set, last) says that a basket
    holds a frequent set, which is its head and one last item. Two occurrences of one basket and head make a longer set: so
    a set is only extended by items that are frequent with its head, and what is counted by (set, item), with partial
    sums before the shuffle, is pruned. Occurrences of the next level are made again from the sets that grew alone."""
    found = stored(found.select("part", "basket", "items"), "baskets")
    rows = found.select("part", "basket", F.explode("items").alias("item"))
    single = rows.groupBy("part", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    names = stored(dense_ids(single, "item", "code").select("item", F.col("code").cast("int").alias("code")), "names")
    frequent = stored(single.join(names, "item").select("part", F.array("item").alias("items"), F.col("code").cast("long").alias("set"), "code", "n"), "frequent")
    coded = rows.join(bounded(names, ("item",)), "item").join(frequent.select("part", "code"), ["part", "code"], "left_semi")
    level = stored(coded.select("part", "basket", F.lit(-1).cast("long").alias("head"), F.col("code").cast("long").alias("set"), F.col("code").alias("last")), "level")
    out = frequent.select("part", "items", "n")
    held = [level]

    def longer(of: DataFrame) -> DataFrame:
        other = level.select("part", "basket", "head", F.col("last").alias("code"))
        return of.join(other, ["part", "basket", "head"]).where(F.col("code") > F.col("last")).select("part", "basket", "set", "code")

    while True:
        counts = longer(level).groupBy("part", "set", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        grown = counts.join(names, "code").join(frequent.select("part", "set", F.col("items").alias("before")), ["part", "set"])
        now = grown.select("part", F.concat("before", F.array("item")).alias("items"), F.col("set").alias("head"), "code", "n")
        now = stored(now.withColumn("set", F.monotonically_increasing_id()), "frequent")
        n = now.count()
        if not n:
            for frame in held:
                remove(frame)
            return out
        out = out.unionByName(now.select("part", "items", "n"))
        kept = now.select("part", "head", "code", F.col("set").alias("new"))
        kept = F.broadcast(kept) if n <= BROADCAST_ROWS else kept  # four numbers a row
        grew = level.join(kept.select("part", F.col("head").alias("set")), ["part", "set"], "left_semi")
        met = longer(grew).withColumnRenamed("set", "head").join(kept, ["part", "head", "code"])
        level = stored(met.select("part", "basket", "head", F.col("new").alias("set"), F.col("code").alias("last")), "level")
        held = [*held, level]
        frequent = now


def count_candidates(found: DataFrame, candidates: DataFrame, support: int) -> DataFrame:
    """Second pass: items, freq of the candidates that at least ``support`` baskets hold.

    A candidate meets the baskets by its items; it is held where all of them are."""
    each = candidates.distinct().select("items", F.explode("items").alias("item"))
    rows = found.select("basket", F.explode("items").alias("item"))
    held = rows.join(each, "item").groupBy("items", "basket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.size("items"))
    return held.groupBy("items").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= support)
