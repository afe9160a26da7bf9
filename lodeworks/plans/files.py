"""Queries that go through files: the test tables are written in the workloads' formats and read back by the library's readers,
reports are written by its writers and their text is the result. All files lie in the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.operators import clusters, graph, itemsets, layout, profile
from lodeworks.sources import readers, sinks, tables
from lodeworks.storage import new_path, stored, table
from lodeworks.streaming import profile as streaming

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """place (from 1), line: part files in the order of their names, lines in their order."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return rows.select(F.row_number().over(Window.orderBy("file", "at")).alias("place"), "line")  # small reports


def _reviews(spark: SparkSession, d: str) -> str:
    """Orders as JSON lines of reviews."""
    path = new_path(spark, "reviews")
    orders = table(spark, d, "orders")
    orders.select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("business_id"),
        (1.0 + F.col("o_orderkey") % 5).alias("stars"), F.col("o_orderdate").cast("string").alias("date"),
    ).write.json(path)
    return path


@query
def file_profile(spark: SparkSession, d: str) -> DataFrame:
    """Reviews from JSON lines, in at least four partitions; the profile as a JSON document, read back."""
    reviews = readers.with_min_partitions(readers.reviews(spark, _reviews(spark, d), ("user_id", "business_id", "date")), 4)
    path = new_path(spark, "profile")
    sinks.write_json_document(profile.profile_report(reviews, "user_id", "business_id", "date", 1998), path, spark)
    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    rows = [(k, x[0], x[1]) for k, v in found.items() if isinstance(v, list) for x in v] + [(k, "", v) for k, v in found.items() if not isinstance(v, list)]
    return spark.createDataFrame(rows, "metric string, key string, value long")


@query
def file_averages(spark: SparkSession, d: str) -> DataFrame:
    """Reviews and businesses from JSON lines; city,avg lines, read back."""
    left, right, out = (new_path(spark, name) for name in ("reviews", "businesses", "averages"))
    orders = table(spark, d, "orders")
    orders.select(
        F.lit("u").alias("user_id"), F.col("o_custkey").cast("string").alias("business_id"), (1.0 + F.col("o_orderkey") % 5).alias("stars"), F.lit("2018-01-01").alias("date")
    ).write.json(left)
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    table(spark, d, "customer").join(nations, "c_nationkey").select(
        F.col("c_custkey").cast("string").alias("business_id"), "city", F.lit(1.0).alias("stars"), F.lit(1).alias("review_count")
    ).write.json(right)
    reviews, businesses = readers.reviews(spark, left, ("business_id", "stars")), readers.businesses(spark, right, ("business_id", "city"))
    sinks.write_averages(profile.join_average(reviews, businesses, "business_id", "city", "stars", "avg_stars"), out)
    parts = readers.fields(F.col("line"))
    return text_lines(spark, out).select(F.get(parts, F.lit(0)).alias("city"), F.round(F.get(parts, F.lit(1)).cast("double"), 6).alias("avg_stars"))


@query
def file_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated pairs with a header in each file: the header as given, and the first line taken as header."""
    path = new_path(spark, "pairs")
    rows = tables.purchases(spark, d).select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("business_id"))
    rows.repartition(3).write.csv(path, header=True)
    out = None
    for kind, header in (("given", "user_id,business_id"), ("first", None)):
        found = readers.pairs(spark, path, header).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("business_id").alias("n_items"))
        one = found.select(F.lit(kind).alias("header"), "user_id", "n", "n_items")
        out = one if out is None else out.unionByName(one)
    return out


@query
def file_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings to a file whose header has spaces, and back."""
    path = new_path(spark, "ratings")
    sinks.write_spaced_csv(tables.ratings(spark, d).toDF("user_id", "business_id", "stars").orderBy("user_id", "business_id"), path)
    return readers.ratings(spark, path)


@query
def file_points(spark: SparkSession, d: str) -> DataFrame:
    """Header-less numeric lines of as many features as there are, and back."""
    path = new_path(spark, "points")
    rows = tables.embedding_points(spark, d)
    rows.select(F.concat_ws(",", F.col("pid").cast("string"), F.col("truth").cast("string"), F.col("features").cast("array<string>")).alias("value")).write.text(path)
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return readers.points(spark, path).select("pid", "truth", F.size("features").alias("dims"), F.round(total, 6).alias("total"))


@query
def file_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """The itemset report, read back: section, size, line."""
    path = new_path(spark, "itemsets")
    found = stored(itemsets.baskets(tables.purchases(spark, d), "o_custkey", "l_suppkey"), "baskets")
    sinks.write_itemsets([("Candidates", itemsets.local_frequent(found, 300, 4)), ("Frequent Itemsets", itemsets.frequent_itemsets(found, 180))], path)
    rows, section, size = [], "", 0
    for r in spark.read.text(path).collect():  # a line for each size
        if r.value.endswith(":"):
            section, size = r.value[:-1], 0
        elif r.value:
            size += 1
            rows.append((section, size, r.value))
    return spark.createDataFrame(rows, "section string, size int, line string")


@query
def file_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edge lines, largest value first, read back: place, line. The value is the number of shared items."""
    path = new_path(spark, "edges")
    counted = graph.co_occurrences(tables.purchases(spark, d), "o_custkey", "l_partkey").where("n >= 7")
    sinks.write_edges(counted.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.col("n").cast("double").alias("betweenness")), path)
    return text_lines(spark, path)


@query
def file_communities(spark: SparkSession, d: str) -> DataFrame:
    """Community lines, smallest first, read back: place, line. The communities are the components."""
    path = new_path(spark, "communities")
    found = graph.components(graph.co_occurrence_edges(tables.purchases(spark, d), "o_custkey", "l_partkey", 7))
    sinks.write_communities(found.groupBy("component").agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("members")), path)
    return text_lines(spark, path)


@query
def file_clustering(spark: SparkSession, d: str) -> DataFrame:
    """The clustering report, read back: kind, place, line. Labels are the nearest of the given clusters, -1 for none."""
    path = new_path(spark, "clustering")
    points = tables.embedding_points(spark, d)
    labels = clusters.nearest(points, clusters.cluster_stats(points, "truth"), 1.03).select("pid", F.coalesce("cluster", F.lit(-1)).alias("label"))
    sinks.write_clustering(clusters.rounds_frame(spark, [(2, 7, 1, 2, 3), (1, 5, 0, 0, 4)]), labels, path)
    kinds = [text_lines(spark, f"{path}/{kind}").select(F.lit(kind).alias("kind"), "place", "line") for kind in ("rounds", "labels")]
    return kinds[0].unionByName(kinds[1])


@query
def file_stream(spark: SparkSession, d: str) -> DataFrame:
    """Reviews as a stream of files, counted by user as they come; the last complete counts."""
    out, marks = new_path(spark, "counts"), new_path(spark, "marks")
    counts = streaming.key_counts(streaming.review_stream(spark, _reviews(spark, d)), "user_id")
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True)
    running = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    running.awaitTermination()
    return spark.read.parquet(out)


@query
def layout_facts(spark: SparkSession, d: str) -> DataFrame:
    """name, value of layouts: numbers of partitions, and the partitions that the rows of one string key are in."""
    orders = table(spark, d, "orders").select("o_orderpriority")
    by_hash = layout.place(orders, 6, F.hash("o_orderpriority"))
    facts = [
        ("at_most", layout.at_most(orders.repartition(6), 4).rdd.getNumPartitions()), ("by_key", layout.by_key(orders, 3, "o_orderpriority").rdd.getNumPartitions()),
        ("at_least", readers.with_min_partitions(orders.coalesce(1), 5).rdd.getNumPartitions()), ("own", by_hash.rdd.getNumPartitions()),
    ]
    return layout.most_partitions_of_a_key(by_hash, "o_orderpriority").select(F.lit("parts_of_a_key").alias("name"), F.col("max_parts").alias("value")).unionByName(
        spark.createDataFrame(facts, "name string, value long")
    )
