"""Relational profiling: counts, distinct keys, top-k, join and average, JSON fields, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def in_year(date: Column, year: int) -> Column:
    """Dates as text: the year is what stands before the first dash. A timestamp's text has the same form."""
    return F.split_part(date.cast("string"), F.lit("-"), F.lit(1)) == str(year)


def count_year(df: DataFrame, date: str, year: int) -> DataFrame:
    return df.agg(F.count_if(in_year(F.col(date), year)).alias("n"))


def distinct_keys(key: str) -> Column:
    """Aggregate: number of distinct keys, a null key counting as one."""
    return F.count_distinct(key) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))


def top_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys; equal counts by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def profile(df: DataFrame, user: str, item: str, date: str, year: int, k: int = 10) -> DataFrame:
    """metric, key, value: all counts from one aggregation, and the top keys of users and items."""
    one = df.agg(
        F.count(F.lit(1)).alias("n_review"), F.count_if(in_year(F.col(date), year)).alias("n_review_year"),
        distinct_keys(user).alias("n_user"), distinct_keys(item).alias("n_business"),
    )
    counts = one.unpivot([], one.columns, "metric", "value").select("metric", F.lit("").alias("key"), F.col("value").cast("long").alias("value"))
    for metric, key in (("top_user", user), ("top_business", item)):
        counts = counts.unionByName(top_keys(df, key, k).select(F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"), F.col("n").alias("value")))
    return counts


def profile_report(df: DataFrame, user: str, item: str, date: str, year: int, k: int = 10) -> dict:
    """The profile as one document: four counts and two lists of at most k pairs."""
    rows = profile(df, user, item, date, year, k).collect()
    report: dict = {r.metric: r.value for r in rows if not r.metric.startswith("top_")}
    for name in ("user", "business"):
        ranked = sorted(((r.key, r.value) for r in rows if r.metric == f"top_{name}"), key=lambda x: (-x[1], x[0]))
        report[f"top{k}_{name}"] = [list(x) for x in ranked]
    return report


def join_average(left: DataFrame, right: DataFrame, on: str, group: str, value: str, name: str) -> DataFrame:
    """Average of left.value by right.group over the inner join, best first."""
    joined = left.select(on, value).join(right.select(on, group), on)
    return joined.groupBy(group).agg(F.avg(value).alias(name)).orderBy(F.desc(name), group)


def json_field(df: DataFrame, column: str, field: str, kind: str) -> Column:
    """A field of a JSON text column."""
    return F.from_json(column, f"`{field}` {kind}")[field]


def normalised(df: DataFrame, stars: str, count: str) -> DataFrame:
    """stars / 5 and count / (largest count) as columns; the largest is a one-row broadcast."""
    most = df.agg(F.max(count).alias("most"))
    return df.crossJoin(F.broadcast(most)).withColumns({
        "norm_stars": F.col(stars) / 5.0, "norm_count": F.try_divide(F.col(count).cast("double"), F.col("most")),
    }).drop("most")
