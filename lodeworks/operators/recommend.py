"""Ratings and recommenders: statistics, similarities, user-, item-based and hybrid prediction, ALS, RMSE.

Ratings are (user, item, stars), one row a pair; ``dedupe`` makes them so. Predictions carry the branch that made them.
Pair weights are computed once for each distinct pair that a target needs.

Defined cases: rows with a null user, item or stars belong to no pair's weight and to no prediction's sum; repeated ratings are
one (the largest) after ``dedupe``; repeated targets get one row; where all weights are zero the fallback of the branch
holds; an empty training table sends every target to its fallback; empty targets give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import dense_ids
from lodeworks.functions.pairing import paired, sharing
from lodeworks.storage import remove, stored


def dedupe(ratings: DataFrame) -> DataFrame:
    """One rating a pair: the largest, which does not depend on any order of rows."""
    return ratings.groupBy("user", "item").agg(F.max("stars").alias("stars"))


def stats(ratings: DataFrame, key: str) -> DataFrame:
    """key, total, norm (sum of squares), n."""
    return ratings.groupBy(key).agg(F.sum("stars").alias("total"), F.sum(F.col("stars") * F.col("stars")).alias("norm"), F.count(F.lit(1)).alias("n"))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(1.0)), F.lit(5.0))


def co_rated(ratings: DataFrame, pairs: DataFrame | None, key: str, shared: str) -> DataFrame:
    """a < b, x, y: ratings of both sides for each shared entity, of all pairs that share one or at least of the given pairs.

    Either the ratings meet on the shared entity, or each pair looks up its ratings, whichever makes fewer rows."""
    left = ratings.select(F.col(key).alias("a"), F.col(shared).alias("s"), F.col("stars").alias("x"))
    right = ratings.select(F.col(key).alias("b"), F.col(shared).alias("s"), F.col("stars").alias("y"))
    if pairs is not None:
        n = F.count(F.lit(1))
        met = ratings.groupBy(shared).agg(n.alias("n")).agg(F.sum(F.col("n") * F.col("n")) / 2).first()[0] or 0
        rows, keys = ratings.agg(n, F.count_distinct(key)).first()
        if met > pairs.count() * (rows / max(1, keys)):
            return pairs.join(left, "a").join(right, ["b", "s"])
    rows = ratings.select(F.col(shared).alias("s"), F.col(key).alias("k"), "stars")
    met = sharing(rows, "s", "k", [F.col("k").alias("a"), F.col("stars").alias("x")], [F.col("k").alias("b"), F.col("stars").alias("y")])
    return met.where("a < b")


def cosine(ratings: DataFrame, pairs: DataFrame | None, key: str, shared: str) -> DataFrame:
    """a, b, w of all pairs, or the given ones (a < b), that share an entity; others have weight 0 and no row."""
    norm = stats(ratings, key).select(key, "norm")
    if pairs is None:
        # The norms travel with the ratings: a join with them would shuffle all pairs.
        rows = stored(ratings.select(key, shared, "stars").join(norm, key), "normed")
        dot = F.sum(F.col("x.stars") * F.col("y.stars")).alias("dot")
        dots = paired(rows, shared, key, ["stars", "norm"], dot, F.max("x.norm").alias("na"), F.max("y.norm").alias("nb"))
        remove(rows)
        return dots.select("a", "b", F.try_divide("dot", F.sqrt(F.col("na") * F.col("nb"))).alias("w"))
    dots = co_rated(ratings, pairs, key, shared).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    if pairs is not None:
        dots = dots.join(pairs, ["a", "b"], "left_semi")
    with_a = dots.join(norm.select(F.col(key).alias("a"), F.col("norm").alias("na")), "a")
    with_b = with_a.join(norm.select(F.col(key).alias("b"), F.col("norm").alias("nb")), "b")
    return with_b.select("a", "b", F.try_divide("dot", F.sqrt(F.col("na") * F.col("nb"))).alias("w"))


def pearson(ratings: DataFrame, pairs: DataFrame | None, key: str, shared: str) -> DataFrame:
    """a, b, w: correlation over what both have rated; 0 where the numerator is 0."""
    n = F.count(F.lit(1))
    sums = co_rated(ratings, pairs, key, shared).groupBy("a", "b").agg(
        (F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.sum("y") / n).alias("p"),
        (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / n).alias("qa"),
        (F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / n).alias("qb"),
    )
    if pairs is not None:
        sums = sums.join(pairs, ["a", "b"], "left_semi")
    none = F.abs("p") < 1e-9
    return sums.select("a", "b", F.when(none, F.lit(0.0)).otherwise(F.try_divide("p", F.sqrt(F.greatest(F.col("qa") * F.col("qb"), F.lit(0.0))))).alias("w"))


def content(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, w: cosine of (norm_stars, norm_count). features: item, norm_stars, norm_count."""
    one = pairs.join(features.select(F.col("item").alias("a"), F.col("norm_stars").alias("s1"), F.col("norm_count").alias("c1")), "a")
    two = one.join(features.select(F.col("item").alias("b"), F.col("norm_stars").alias("s2"), F.col("norm_count").alias("c2")), "b")
    dot = F.col("s1") * F.col("s2") + F.col("c1") * F.col("c2")
    size = F.sqrt((F.col("s1") ** 2 + F.col("c1") ** 2) * (F.col("s2") ** 2 + F.col("c2") ** 2))
    return two.select("a", "b", F.try_divide(dot, size).alias("w"))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def _facts(train: DataFrame, features: DataFrame, targets: DataFrame) -> DataFrame:
    """user, item, known, f_stars, means and sizes of both sides; nulls where there is none."""
    users = stats(train, "user").select("user", (F.col("total") / F.col("n")).alias("user_mean"))
    items = stats(train, "item").select("item", (F.col("total") / F.col("n")).alias("item_mean"))
    known = train.withColumnRenamed("stars", "known")
    return (
        targets.select("user", "item").distinct().join(known, ["user", "item"], "left").join(users, "user", "left")
        .join(items, "item", "left").join(features.select("item", F.col("stars").alias("f_stars")), "item", "left")
    )


def predict_user_based(train: DataFrame, features: DataFrame, targets: DataFrame) -> DataFrame:
    """user, item, branch, prediction.

    A known rating; for a new user the item's stars, else 3; for an item nobody rated the user's mean; else the user's
    mean plus the weighted deviations of its raters (each from its mean without this item), held within 1 and 5."""
    facts = stored(_facts(train, features, targets), "facts")
    branch = (
        F.when(F.col("known").isNotNull(), "known").when(F.col("user_mean").isNull(), "new_user")
        .when(F.col("item_mean").isNull(), "new_item").otherwise("cf")
    )
    facts = facts.withColumn("branch", branch)
    need = facts.where("branch = 'cf'").select("user", "item")
    others = train.select(F.col("user").alias("other"), "item", "stars")
    met = stored(need.join(others, "item"), "met")
    pairs = stored(_ordered(met, "user", "other"), "pairs")
    weights = cosine(train, pairs, "user", "item").where("w > 0")
    st = stats(train, "user").select(F.col("user").alias("other"), "total", "n")
    each = met.withColumns({"a": F.least("user", "other"), "b": F.greatest("user", "other")}).join(weights, ["a", "b"]).join(st, "other")
    gap = F.col("stars") - F.try_divide(F.col("total") - F.col("stars"), F.col("n") - 1)
    summed = each.groupBy("user", "item").agg(F.sum(gap * F.col("w")).alias("p"), F.sum(F.abs("w")).alias("q"))
    cf = F.when(F.coalesce("q", F.lit(0.0)) == 0, F.col("user_mean")).otherwise(clamp(F.col("user_mean") + F.try_divide("p", "q")))
    value = (
        F.when(F.col("branch") == "known", F.col("known")).when(F.col("branch") == "new_user", F.coalesce("f_stars", F.lit(3.0)))
        .when(F.col("branch") == "new_item", F.col("user_mean")).otherwise(cf)
    )
    return facts.join(summed, ["user", "item"], "left").select("user", "item", "branch", value.alias("prediction"))


def _predict_by_items(train: DataFrame, features: DataFrame, targets: DataFrame, hybrid: bool) -> DataFrame:
    facts = _facts(train, features, targets).withColumn("base", F.coalesce("f_stars", "item_mean"))
    no_base = F.col("base").isNull() if hybrid else F.col("item_mean").isNull()
    branch = F.when(F.col("known").isNotNull(), "known").when(no_base, "new_item").when(F.col("user_mean").isNull(), "new_user").otherwise("cf")
    facts = stored(facts.withColumn("branch", branch), "facts")
    need = facts.where("branch = 'cf'").select("user", "item")
    others = train.select("user", F.col("item").alias("other"), "stars")
    met = stored(need.join(others, "user"), "met")
    pairs = stored(_ordered(met, "item", "other"), "pairs")
    weights = cosine(train, pairs, "item", "user").where("w <> 0")
    if hybrid:
        by_content = content(features, pairs).withColumnRenamed("w", "v")
        both = pairs.join(weights, ["a", "b"], "left").join(by_content, ["a", "b"], "left")
        weights = both.select("a", "b", F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("v")).alias("w")).where("w > 0")
    means = stats(train, "item").select("item", (F.col("total") / F.col("n")).alias("m"))
    means = means.join(features.select("item", F.col("stars").alias("fs")), "item", "left").select(F.col("item").alias("other"), F.coalesce("fs", "m").alias("mean"))
    each = met.withColumns({"a": F.least("item", "other"), "b": F.greatest("item", "other")}).join(weights, ["a", "b"]).join(means, "other")
    gap = (F.col("stars") - F.col("mean")) * F.col("w")
    summed = each.groupBy("user", "item").agg(F.sum(gap).alias("p"), F.sum(F.abs("w")).alias("q"))
    none = (F.coalesce("q", F.lit(0.0)) == 0) | (F.abs("p") < 1e-12)
    cf = F.when(none, F.col("base")).otherwise(clamp(F.col("base") + F.try_divide("p", "q")))
    value = (
        F.when(F.col("branch") == "known", F.col("known")).when(F.col("branch") == "new_item", F.lit(3.5) if hybrid else F.coalesce("f_stars", F.lit(3.0)))
        .when(F.col("branch") == "new_user", F.col("base")).otherwise(cf)
    )
    return facts.join(summed, ["user", "item"], "left").select("user", "item", "branch", value.alias("prediction"))


def predict_item_based(train: DataFrame, features: DataFrame, targets: DataFrame) -> DataFrame:
    """user, item, branch, prediction.

    A known rating; for an item nobody rated its stars, else 3; for a new user the item's mean (its stars where given);
    else that mean plus the weighted deviations of the user's other ratings from their items' means."""
    return _predict_by_items(train, features, targets, hybrid=False)


def predict_hybrid(train: DataFrame, features: DataFrame, targets: DataFrame) -> DataFrame:
    """As by items, but weights come from content where the cosine is not positive, and an unknown item gets 3.5.

    features: item, stars, norm_stars, norm_count."""
    return _predict_by_items(train, features, targets, hybrid=True)


def predict_als(train: DataFrame, targets: DataFrame, rank: int = 2, iterations: int = 10, penalty: float = 0.01, seed: int = 7) -> DataFrame:
    """user, item, prediction of non-negative factors; targets with an unknown user or item have no row."""
    users, items = stored(dense_ids(train, "user", "u"), "users"), stored(dense_ids(train, "item", "i"), "items")

    def coded(df):
        return df.join(users, "user").join(items, "item").withColumns({"u": F.col("u").cast("int"), "i": F.col("i").cast("int")})

    als = ALS(rank=rank, maxIter=iterations, regParam=penalty, nonnegative=True, seed=seed, userCol="u", itemCol="i", ratingCol="stars", coldStartStrategy="drop")
    model = als.fit(coded(train))
    return model.transform(coded(targets.select("user", "item").distinct())).select("user", "item", F.col("prediction").cast("double").alias("prediction"))


def rmse(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """rmse over the pairs that have a prediction."""
    both = actual.join(predicted.select("user", "item", "prediction"), ["user", "item"])
    return both.agg(F.sqrt(F.avg((F.col("stars") - F.col("prediction")) ** 2)).alias("rmse"))
