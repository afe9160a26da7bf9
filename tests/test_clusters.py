import math
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import clusters

POINTS = "pid long, truth int, features array<double>"


def test_statistics(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 6.0])], POINTS)
    stats = clusters.cluster_stats(df, "truth")
    row = stats.first()
    assert (row.n, row.sums, row.squares) == (2, [4.0, 8.0], [10.0, 40.0])
    shape = clusters.shapes(stats).first()
    assert (shape.centroid, shape.sigma) == ([2.0, 4.0], [1.0, 2.0])
    new = spark.createDataFrame([(3, 0, [3.0, 4.0]), (4, 0, [4.0, 8.0])], POINTS)
    assert {r.pid: r.distance for r in clusters.distances(new, stats).collect()} == {3: 1.0, 4: pytest.approx(2.8284271)}
    assert {r.pid: r.cluster for r in clusters.nearest(new, stats).collect()} == {3: 0, 4: None}


def test_merging_adds_up(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 1, [3.0, 6.0]), (3, 2, [5.0, 1.0])], POINTS)
    parts = clusters.cluster_stats(df, "truth").withColumn("to", F.when(F.col("cluster") < 2, 0).otherwise(1))
    found = {r.cluster: (r.n, r.sums, r.squares) for r in clusters.merged(parts, "to").collect()}
    assert found == {0: (2, [4.0, 8.0], [10.0, 40.0]), 1: (1, [5.0, 1.0], [25.0, 1.0])}


def test_zero_deviation_attracts_nothing(spark):
    stats = clusters.cluster_stats(spark.createDataFrame([(1, 0, [1.0, 2.0])], POINTS), "truth")
    same = spark.createDataFrame([(2, 0, [1.0, 2.0])], POINTS)
    assert clusters.distances(same, stats).first().distance is None
    assert clusters.nearest(same, stats).first().cluster is None


def test_merge_pairs(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i % 2 * 5 + i % 3), float(i % 5)]) for i in range(60)], POINTS)
    stats = clusters.cluster_stats(df, "truth")
    wide = clusters.merge_pairs(stats, 100.0).collect()
    assert [(r.a, r.b) for r in wide] == [(0, 1)]
    assert clusters.merge_pairs(stats, wide[0].distance).count() == 0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(4)
    rows = []
    for pid in range(3000):
        c = pid % 3
        rows.append((pid, c, [rng.gauss(20 * c, 1), rng.gauss(-15 * c, 1)]))
    rows += [(3000 + i, -1, [rng.uniform(200, 2000) * (1 + i), rng.uniform(200, 2000)]) for i in range(15)]
    return spark.createDataFrame(rows, POINTS)


def test_bfr(spark, blobs):
    model = clusters.Bfr(3)
    labels = {r.pid: r.label for r in model.fit(blobs).collect()}
    assert len(labels) == 3015 and set(labels.values()) <= {-1, 0, 1, 2}
    sizes = {r.chunk: r["count"] for r in clusters.chunks(blobs).groupBy("chunk").count().collect()}
    seen = 0
    for number, ds, _, cs_points, rs in model.rounds:
        seen += sizes[number]
        assert ds + cs_points + rs == seen
    assert sum(v >= 0 for v in labels.values()) == model.rounds[-1][1]
    # Each blob goes to one cluster, but for a few points beyond the radius.
    for c in range(3):
        own = [labels[p] for p in range(3000) if p % 3 == c and labels[p] >= 0]
        assert len(own) > 800 and len(set(own)) == 1
    again = clusters.Bfr(3)
    assert {r.pid: r.label for r in again.fit(blobs).collect()} == labels and again.rounds == model.rounds


def test_equal_points_keep_their_ids(spark):
    df = spark.createDataFrame([(i, 0, [float(i % 4), float(i % 3)]) for i in range(600)], POINTS)
    labels = clusters.Bfr(2).fit(df).collect()
    assert sorted(r.pid for r in labels) == list(range(600))


def test_bfr_of_nothing(spark):
    assert clusters.Bfr(2).fit(spark.createDataFrame([], POINTS)).count() == 0


def test_confusion(spark):
    truth = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [0.0])], POINTS)
    labels = spark.createDataFrame([(1, 5), (2, 5)], "pid long, label int")
    row = clusters.confusion(labels, truth).first()
    assert (row.truth, row.label, row.n) == (0, 5, 2) and math.isfinite(row.n)
