"""The query catalogue: name -> (spark, sf_dir) -> DataFrame over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.hashing import dense_ids
from lodeworks.operators import clusters, communities, graph, itemsets, layout, profile, recommend, similarity
from lodeworks.plans import files
from lodeworks.sources import sinks, tables
from lodeworks.storage import kept, spread_table, stored, table

SUPPORT, CANDIDATE_SUPPORT, REPORT_SUPPORT, PARTS = 85, 300, 180, 4
SHARED, RADIUS_FACTOR, MERGE_LIMIT, K = 7, 1.03, 10.0, 5
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def six(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def four(c: str) -> F.Column:
    """Averages of cents may lie just between two rounded values, where the order of a sum decides; a nudge takes them off that edge."""
    return F.round(F.col(c) + 1e-7, 4).alias(c)


def joined(items: str = "items") -> F.Column:
    return F.array_join(items, ",").alias("items")


@query
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return profile.count_all(table(spark, d, "events"))


@query
def count_year(spark: SparkSession, d: str) -> DataFrame:
    return profile.count_year(table(spark, d, "orders"), "o_orderdate", 1998)


@query
def count_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(profile.distinct_keys("user_id").alias("n_users"), profile.distinct_keys("event_type").alias("n_types"))


@query
def top10_users(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_keys(table(spark, d, "events"), "user_id")


@query
def top10_products(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_keys(table(spark, d, "lineitem"), "l_partkey")


@query
def profile_long(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", 1998)


@query
def json_field_agg(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    rows = events.select("event_type", profile.json_field(events, "props", "k", "long").alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def _nation_averages(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nations, "c_nationkey")
    return profile.join_average(table(spark, d, "orders"), customers, "o_custkey", "n_name", "o_totalprice", "avg_price")


@query
def region_avg(spark: SparkSession, d: str) -> DataFrame:
    return _nation_averages(spark, d).select("n_name", four("avg_price"))


@query
def top10_avg(spark: SparkSession, d: str) -> DataFrame:
    return _nation_averages(spark, d).limit(10).select("n_name", four("avg_price"))


@query
def global_max_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (1.0 + F.col("p_size") % 5).alias("stars"), F.col("p_size").alias("review_count"))
    return profile.normalised(rows, "stars", "review_count").select("p_partkey", six("norm_stars"), six("norm_count"))


@query
def partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return layout.partition_sizes(layout.place(table(spark, d, "orders").select("o_custkey"), 8, F.col("o_custkey")), 8)


@query
def colocation_check(spark: SparkSession, d: str) -> DataFrame:
    return layout.most_partitions_of_a_key(layout.place(table(spark, d, "orders").select("o_custkey"), 8, F.col("o_custkey")), "o_custkey")


@query
def baskets_by_user(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(tables.purchases(spark, d), "o_custkey", "l_suppkey").select("basket", joined())


@query
def baskets_by_item(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(tables.purchases(spark, d), "l_suppkey", "o_custkey").select("basket", joined())


@query
def baskets_filtered(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(tables.purchases(spark, d), "o_custkey", "l_suppkey", more_than=40).select("basket", joined())


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(tables.purchases(spark, d), "o_custkey", "l_suppkey")


@query
def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.frequent_itemsets(_baskets(spark, d), SUPPORT).select(joined(), F.size("items").alias("size"), "freq")


@query
def fp_growth_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.fp_growth(_baskets(spark, d), REPORT_SUPPORT).select(joined(), F.size("items").alias("size"), "freq")


@query
def itemset_candidates(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.local_frequent(_baskets(spark, d), CANDIDATE_SUPPORT, PARTS).select(joined(), F.size("items").alias("size"))


@query
def itemset_two_pass(spark: SparkSession, d: str) -> DataFrame:
    found = stored(_baskets(spark, d), "baskets")
    return itemsets.count_candidates(found, itemsets.local_frequent(found, CANDIDATE_SUPPORT, PARTS), CANDIDATE_SUPPORT).select(joined(), "freq")


@query
def itemset_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.itemset_report(itemsets.frequent_itemsets(_baskets(spark, d), REPORT_SUPPORT), "Frequent Itemsets")


def _token_sets(spark: SparkSession, d: str) -> DataFrame:
    return similarity.token_sets(spread_table(spark, d, "documents"), "doc_id", "text")


@query
def exact_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return similarity.exact_pairs(_token_sets(spark, d), 0.5).select("id1", "id2", six("similarity"))


@query
def jaccard_links(spark: SparkSession, d: str) -> DataFrame:
    return similarity.link_counts(_token_sets(spark, d), 0.5)


@query
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return similarity.signatures(_token_sets(spark, d)).select("id", F.array_join("signature", ",").alias("signature"))


@query
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return similarity.candidates(stored(similarity.signatures(_token_sets(spark, d)), "signatures"))


@query
def lsh_similar(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar_by_minhash(_token_sets(spark, d), 0.5).select("id1", "id2", six("similarity"))


@query
def rating_stats(spark: SparkSession, d: str) -> DataFrame:
    return recommend.stats(tables.ratings(spark, d), "user")


@query
def item_user_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    rated = tables.ratings(spark, d)
    users = dense_ids(rated, "user", "id").select(F.lit("user").alias("kind"), F.col("user").alias("key"), F.col("id").cast("long").alias("id"))
    items = dense_ids(rated, "item", "id").select(F.lit("item").alias("kind"), F.col("item").alias("key"), F.col("id").cast("long").alias("id"))
    return users.unionByName(items)


def _pairs(rated: DataFrame, key: str, shared: str) -> DataFrame:
    """All pairs a < b of keys that share an entity."""
    a, b = rated.select(F.col(key).alias("a"), shared), rated.select(F.col(key).alias("b"), shared)
    return a.join(b, shared).where("a < b").select("a", "b").distinct()


@query
def cosine_users(spark: SparkSession, d: str) -> DataFrame:
    rated = stored(tables.ratings(spark, d), "ratings")
    return recommend.cosine(rated, None, "user", "item").select("a", "b", six("w"))


@query
def cosine_items(spark: SparkSession, d: str) -> DataFrame:
    rated = stored(tables.ratings(spark, d), "ratings")
    return recommend.cosine(rated, None, "item", "user").select("a", "b", six("w"))


@query
def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    rated = stored(tables.ratings(spark, d), "ratings")
    return recommend.pearson(rated, None, "user", "item").select("a", "b", six("w"))


@query
def pearson_item_pairs(spark: SparkSession, d: str) -> DataFrame:
    rated = stored(tables.ratings(spark, d), "ratings")
    return recommend.pearson(rated, None, "item", "user").select("a", "b", six("w"))


@query
def content_similarity(spark: SparkSession, d: str) -> DataFrame:
    rated = stored(tables.ratings(spark, d), "ratings")
    return recommend.content(tables.features(spark, d), _pairs(rated, "item", "user")).select("a", "b", six("w"))


def _predicted(how, spark: SparkSession, d: str) -> DataFrame:
    trained, wanted = stored(tables.train(spark, d), "train"), stored(tables.targets(spark, d), "targets")
    return how(trained, tables.features(spark, d), wanted)


@query
def predict_user_cf(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(recommend.predict_user_based, spark, d).select("user", "item", "branch", six("prediction"))


@query
def predict_item_cf(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(recommend.predict_item_based, spark, d).select("user", "item", "branch", six("prediction"))


@query
def predict_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(recommend.predict_hybrid, spark, d).select("user", "item", "branch", six("prediction"))


@query
def rmse_user_cf(spark: SparkSession, d: str) -> DataFrame:
    predicted = _predicted(recommend.predict_user_based, spark, d)
    return recommend.rmse(tables.targets(spark, d), predicted).select(six("rmse"))


@query
def als_predictions(spark: SparkSession, d: str) -> DataFrame:
    return recommend.predict_als(stored(tables.train(spark, d), "train"), tables.targets(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_occurrence_edges(tables.purchases(spark, d), "o_custkey", "l_partkey", SHARED)


@query
def co_rating_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(stored(_edges(spark, d), "edges"))


@query
def bfs_path_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs_table(stored(_edges(spark, d), "edges"))


@query
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_betweenness(_edges(spark, d)).select("src", "dst", six("betweenness"))


@query
def first_removed_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.largest_edges(stored(graph.edge_betweenness(_edges(spark, d)), "scored")).select("src", "dst", six("betweenness"))


@query
def modularity_components(spark: SparkSession, d: str) -> DataFrame:
    edges = stored(_edges(spark, d), "edges")
    return graph.modularity(edges, graph.components(edges)).select(six("q"), six("textbook_q"))


@query
def girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    return communities.communities(_edges(spark, d)).select("community", F.size("members").alias("size"), joined("members"))


@query
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = clusters.cluster_stats(tables.embedding_points(spark, d), "truth")
    each = rows.select("cluster", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("dim", "v"))
    return each.select("cluster", "n", "dim", F.round("v.sums", 6).alias("s"), F.round("v.squares", 6).alias("q"))


@query
def cluster_stats_merged(spark: SparkSession, d: str) -> DataFrame:
    stats = clusters.cluster_stats(tables.embedding_points(spark, d), "truth").withColumn("into", F.col("cluster") % 2)
    rows = clusters.shapes(clusters.merged(stats, "into"))
    each = rows.select("cluster", "n", F.posexplode(F.arrays_zip("centroid", "sigma")).alias("dim", "v"))
    return each.select("cluster", "n", "dim", F.round("v.centroid", 6).alias("c"), F.round("v.sigma", 6).alias("sigma"))


@query
def rows_by_key_partition(spark: SparkSession, d: str) -> DataFrame:
    return layout.most_partitions_of_a_key(layout.by_key(table(spark, d, "orders").select("o_custkey"), 8, "o_custkey"), "o_custkey")


@query
def mahalanobis_all(spark: SparkSession, d: str) -> DataFrame:
    points = tables.embedding_points(spark, d)
    return clusters.distances(points, clusters.cluster_stats(points, "truth")).select("pid", "cluster", six("distance"))


@query
def nearest_cluster(spark: SparkSession, d: str) -> DataFrame:
    points = tables.embedding_points(spark, d)
    return clusters.nearest(points, clusters.cluster_stats(points, "truth"), RADIUS_FACTOR)


@query
def cluster_merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    points = tables.embedding_points(spark, d)
    return clusters.merge_pairs(clusters.cluster_stats(points, "truth"), MERGE_LIMIT).select("a", "b", six("distance"))


@query
def als_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The targets that get a prediction: those whose user and item are both known. finite: it is a non-negative number."""
    found = als_predictions(spark, d)
    return found.select("user", "item", ((F.col("prediction") >= 0) & (F.col("prediction") < float("inf"))).alias("finite"))


@query
def kmeans_labels(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(tables.embedding_points(spark, d), 10).select("pid", "label")


@query
def kmeans_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row of facts that hold for any KMeans result: labels are 0 .. k-1, all in use; points are tighter about their labels' means than about one."""
    labelled = stored(clusters.kmeans(tables.embedding_points(spark, d), 10), "labelled")
    sums = clusters.cluster_stats(labelled, "label").unionByName(clusters.cluster_stats(labelled.withColumn("all", F.lit(-1)), "all"))
    spread = F.aggregate(F.zip_with("sums", "squares", lambda s, q: q - s * s / F.col("n")), F.lit(0.0), lambda acc, x: acc + x)
    each = sums.select("cluster", "n", spread.alias("spread"))
    inside, whole = F.col("cluster").between(0, 9), F.col("cluster") == -1
    return each.agg(
        F.sum(F.when(whole, F.col("n"))).alias("n_points"), F.count(F.when(inside, 1)).alias("n_labels"),
        F.sum(F.when(~inside & ~whole, F.col("n")).otherwise(F.lit(0))).alias("n_misplaced"),
        (F.sum(F.when(inside, F.col("spread"))) < F.sum(F.when(whole, F.col("spread")))).alias("tighter"),
    )


_fits: dict[tuple, tuple[DataFrame, list]] = {}


def _bfr(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    """Labels and rounds. One fit serves all queries of a session, for as long as its labels are stored."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _fits or not kept(_fits[key][0]):
        model = clusters.Bfr(K)
        labels = stored(model.fit(tables.event_points(spark, d)), "labels")
        _fits[key] = (labels, model.rounds)
    return _fits[key]


@query
def bfr_assign(spark: SparkSession, d: str) -> DataFrame:
    return _bfr(spark, d)[0]


@query
def bfr_rounds(spark: SparkSession, d: str) -> DataFrame:
    return clusters.rounds_frame(spark, _bfr(spark, d)[1])


@query
def bfr_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row of facts that hold for any BFR result: each point is labelled once, each round's sets hold all points so far, and the labels are the sets'."""
    labels, rounds = _bfr(spark, d)
    points = tables.event_points(spark, d)
    sizes = {r.chunk: r["count"] for r in clusters.chunks(points).groupBy("chunk").count().collect()}
    seen, add_up = 0, True
    for number, ds, _, cs, rs in rounds:
        seen += sizes.get(number, 0)
        add_up = add_up and ds + cs + rs == seen
    both = points.join(labels.select("pid", "label"), "pid", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("label").isNull()).alias("n_unlabelled"), F.lit(add_up).alias("rounds_add_up"),
        (F.count_if(F.col("label") >= 0) == (rounds[-1][1] if rounds else 0)).alias("labels_are_the_sets"),
    )


@query
def truth_confusion(spark: SparkSession, d: str) -> DataFrame:
    return clusters.confusion(_bfr(spark, d)[0], tables.event_points(spark, d))


@query
def confusion_margins(spark: SparkSession, d: str) -> DataFrame:
    """The truth comparison summed over labels."""
    return truth_confusion(spark, d).groupBy("truth").agg(F.sum("n").alias("n"))


QUERIES.update(files.QUERIES)
