"""Command line: one command for each workload, positional arguments as the workloads have them."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import clusters, communities, graph, itemsets, layout, profile, recommend, similarity
from lodeworks.session import session
from lodeworks.sources import readers, sinks
from lodeworks.storage import clear, stored


def run_profile(spark: SparkSession, reviews: str, out: str) -> None:
    df = readers.reviews(spark, reviews, ("user_id", "business_id", "date"))
    sinks.write_json_document(profile.profile_report(df, "user_id", "business_id", "date", 2018), out)


def run_layout(spark: SparkSession, reviews: str, out: str, partitions: int) -> None:
    df = readers.reviews(spark, reviews, ("business_id",))
    report = layout.layout_report(df, "business_id", partitions)
    for name, frame in (("default", df), ("customized", layout.place(df, partitions, F.hash("business_id")))):
        began = time.perf_counter()
        profile.top_keys(frame, "business_id").collect()
        report[name]["exe_time"] = time.perf_counter() - began
    report["explanation"] = "Rows of a key share a partition in the customized layout; times are as measured in this run."
    sinks.write_json_document(report, out)


def run_averages(spark: SparkSession, reviews: str, businesses: str, out: str, timing: str) -> None:
    left = readers.reviews(spark, reviews, ("business_id", "stars"))
    right = readers.businesses(spark, businesses, ("business_id", "city"))
    found = profile.join_average(left, right, "business_id", "city", "stars", "avg_stars").persist()
    sinks.write_averages(found, out)
    report = {}
    for name, rows in (("m1", lambda: found.collect()[:10]), ("m2", lambda: found.take(10))):
        began = time.perf_counter()
        print([(r.city, r.avg_stars) for r in rows()])
        report[name] = time.perf_counter() - began
    report["explanation"] = "m1 brings all rows to the driver and keeps ten; m2 brings ten. m1 runs first."
    sinks.write_json_document(report, timing)
    found.unpersist()


def _mine(found: DataFrame, support: int, parts: int, out: str) -> None:
    found = stored(found, "baskets")
    local = itemsets.local_frequent(found, support, parts, F.pmod(F.xxhash64("basket"), F.lit(parts)))
    frequent = itemsets.frequent_itemsets(found, support)
    sinks.write_itemsets([("Candidates", local), ("Frequent Itemsets", frequent)], out)


def run_itemsets(spark: SparkSession, case: int, support: int, pairs: str, out: str) -> None:
    basket, item = ("user_id", "business_id") if case == 1 else ("business_id", "user_id")
    _mine(itemsets.baskets(readers.pairs(spark, pairs), basket, item), support, max(support // 4, 1), out)


def run_large_baskets(spark: SparkSession, threshold: int, support: int, pairs: str, out: str) -> None:
    found = itemsets.baskets(readers.pairs(spark, pairs), "user_id", "business_id", more_than=threshold)
    _mine(found, support, max(support // 8, 1), out)


def run_similar(spark: SparkSession, ratings: str, out: str) -> None:
    rows = readers.ratings(spark, ratings)
    sets = rows.groupBy(F.col("business_id").alias("id")).agg(F.array_sort(F.collect_set("user_id")).alias("items"))
    found = similarity.similar_by_minhash(sets, 0.5).orderBy("id1", "id2")
    sinks.write_spaced_csv(found.toDF("business_id_1", "business_id_2", "similarity"), out)


def run_recommend(spark: SparkSession, train: str, features: str, test: str, case: int, out: str) -> None:
    def rated(path):
        return readers.ratings(spark, path).select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), "stars")

    trained, wanted = stored(recommend.dedupe(rated(train)), "train"), rated(test)
    given = readers.businesses(spark, features, ("business_id", "stars")).dropDuplicates(["business_id"])
    known = profile.normalised(given, "stars", "review_count").select(F.col("business_id").alias("item"), "stars", "norm_stars", "norm_count")
    how: dict[int, Callable[[], DataFrame]] = {
        1: lambda: recommend.predict_als(trained, wanted),
        2: lambda: recommend.predict_user_based(trained, known, wanted),
        3: lambda: recommend.predict_item_based(trained, known, wanted),
        4: lambda: recommend.predict_hybrid(trained, known, wanted),
    }
    found = stored(how[case]().select("user", "item", "prediction"), "predictions")
    sinks.write_spaced_csv(found.toDF("user_id", "business_id", "prediction"), out)
    # Only where the test file has stars.
    print(f"RMSE: {recommend.rmse(recommend.dedupe(wanted.where('stars is not null')), found).first().rmse}")


def _graph(spark: SparkSession, pairs: str, least: int) -> DataFrame:
    return stored(graph.co_occurrence_edges(readers.pairs(spark, pairs, header=None), "user_id", "business_id", least), "edges")


def run_betweenness(spark: SparkSession, pairs: str, out: str, least: int = 7) -> None:
    sinks.write_edges(graph.edge_betweenness(_graph(spark, pairs, least)), out)


def run_communities(spark: SparkSession, pairs: str, out: str, least: int = 7) -> None:
    sinks.write_communities(communities.communities(_graph(spark, pairs, least)), out)


def run_clusters(spark: SparkSession, points: str, k: int, out: str) -> None:
    model = clusters.Bfr(k)
    labels = stored(model.fit(readers.points(spark, points)), "labels")
    sinks.write_clustering(clusters.rounds_frame(spark, model.rounds), labels, out)


COMMANDS: dict[str, tuple[Callable, list[tuple[str, type]]]] = {
    "profile": (run_profile, [("reviews", str), ("out", str)]),
    "layout": (run_layout, [("reviews", str), ("out", str), ("partitions", int)]),
    "averages": (run_averages, [("reviews", str), ("businesses", str), ("out", str), ("timing", str)]),
    "itemsets": (run_itemsets, [("case", int), ("support", int), ("pairs", str), ("out", str)]),
    "large-baskets": (run_large_baskets, [("threshold", int), ("support", int), ("pairs", str), ("out", str)]),
    "similar": (run_similar, [("ratings", str), ("out", str)]),
    "recommend": (run_recommend, [("train", str), ("features", str), ("test", str), ("case", int), ("out", str)]),
    "betweenness": (run_betweenness, [("pairs", str), ("out", str)]),
    "communities": (run_communities, [("pairs", str), ("out", str)]),
    "clusters": (run_clusters, [("points", str), ("k", int), ("out", str)]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodeworks", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        command = commands.add_parser(name)
        for argument, kind in arguments:
            command.add_argument(argument, type=kind)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = vars(parser().parse_args(argv))
    run, _ = COMMANDS[given.pop("command")]
    began = time.perf_counter()
    spark = spark or session()
    try:
        run(spark, **given)
    finally:
        clear(spark)
    print(f"Duration: {time.perf_counter() - began:.3f}")


if __name__ == "__main__":
    main()
