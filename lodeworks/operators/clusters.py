"""Clusters by sufficient statistics: normalised distances, nearest cluster, merging, and batch-wise BFR.

Points are (pid, truth, features). Statistics are one row a cluster: n, sums, squares. Within a batch the statistics
stay as they were at its start, so results do not depend on row order. Statistics of bounded number (the discard and
compression sets) come to the driver; points never do.

Defined cases: points without features belong to no cluster (label -1 is for points with features that stay outside) and to no
statistics; a null among the features leaves that dimension's sums without it; repeated points count as often as they occur;
of equally near clusters the smallest number wins; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.vectors import deviation, normalised_distance, scaled
from lodeworks.storage import stored


def cluster_stats(points: DataFrame, cluster: str) -> DataFrame:
    """cluster, n, sums, squares: element-wise sums by dimension, combined before the shuffle."""
    each = points.select(F.col(cluster).alias("cluster"), F.posexplode("features").alias("dim", "x"))
    by_dim = each.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "s", "q")))
    rows = by_dim.groupBy("cluster").agg(F.max("n").alias("n"), ordered.alias("d"))
    return rows.select("cluster", "n", F.transform("d", lambda d: d["s"]).alias("sums"), F.transform("d", lambda d: d["q"]).alias("squares"))


def merged(stats: DataFrame, cluster: str) -> DataFrame:
    """Adds up the statistics of rows of one cluster: merging sets, or adding points as sets of one."""
    each = stats.select(F.col(cluster).alias("cluster"), "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("dim", "v"))
    by_dim = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("v.sums").alias("s"), F.sum("v.squares").alias("q"))
    rows = by_dim.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("d"))
    return rows.select("cluster", "n", F.transform("d", lambda d: d["s"]).alias("sums"), F.transform("d", lambda d: d["q"]).alias("squares"))


def shapes(stats: DataFrame) -> DataFrame:
    """cluster, n, centroid, sigma (population standard deviation)."""
    return stats.select("cluster", "n", scaled(F.col("sums"), F.col("n")).alias("centroid"), deviation(F.col("n"), F.col("sums"), F.col("squares")).alias("sigma"))


def distances(points: DataFrame, stats: DataFrame) -> DataFrame:
    """pid, cluster, distance to every cluster; null where a sigma is zero. stats: a bounded number of clusters."""
    near = F.broadcast(shapes(stats).select("cluster", "centroid", "sigma"))
    return points.crossJoin(near).select("pid", "cluster", normalised_distance(F.col("features"), F.col("centroid"), F.col("sigma")).alias("distance"))


def nearest(points: DataFrame, stats: DataFrame, factor: float = 1.5) -> DataFrame:
    """pid, cluster: the nearest cluster closer than factor * sqrt(dimensions), else null; equal distances by cluster.

    The clusters (a bounded number) are one broadcast array, so a point meets them in place: no row is multiplied, and nothing is shuffled."""
    table = F.broadcast(shapes(stats).where("cluster is not null").agg(F.collect_list(F.struct("cluster", "centroid", "sigma")).alias("clusters")))

    def far(c):
        return F.struct(normalised_distance(F.col("features"), c["centroid"], c["sigma"]).alias("d"), c["cluster"].alias("cluster"))

    radius = F.lit(factor) * F.sqrt(F.size("features"))
    inside = F.filter(F.transform("clusters", far), lambda s: s["d"] < radius)
    return points.crossJoin(table).select("pid", F.array_min(inside)["cluster"].alias("cluster"))


def merge_pairs(stats: DataFrame, limit: float) -> DataFrame:
    """a < b, distance: pairs of clusters whose b-centroid lies closer than limit by a's sigma."""
    own = shapes(stats)
    other = F.broadcast(own.select(F.col("cluster").alias("b"), F.col("centroid").alias("c2")))
    pairs = own.select(F.col("cluster").alias("a"), "centroid", "sigma").join(other, F.col("a") < F.col("b"))
    measured = pairs.select("a", "b", normalised_distance(F.col("c2"), F.col("centroid"), F.col("sigma")).alias("distance"))
    return measured.where(F.col("distance") < limit)


def kmeans(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """points with label (0 .. k-1)."""
    with_vector = points.withColumn("_v", array_to_vector(F.col("features").cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="label").fit(with_vector)
    return model.transform(with_vector).drop("_v")


def chunks(points: DataFrame, n: int = 5, pid: str = "pid") -> DataFrame:
    """points with chunk 1 .. n, of near-equal sizes, by a hash order of the ids: a distributed form of shuffling and slicing.

    The hash's range is cut into equal spans, so a point's chunk needs no rank and no global order."""
    share = F.pmod(F.xxhash64(pid), F.lit(1 << 30))
    return points.withColumn("chunk", (F.floor(share * n / (1 << 30)) + 1).cast("int"))


@dataclass
class _Set:
    """Statistics of one cluster on the driver."""

    n: int
    sums: np.ndarray
    squares: np.ndarray

    def add(self, other: _Set) -> None:
        self.n, self.sums, self.squares = self.n + other.n, self.sums + other.sums, self.squares + other.squares

    def distance(self, point: np.ndarray) -> float:
        centre = self.sums / self.n
        sigma = np.sqrt(np.maximum(self.squares / self.n - centre**2, 0))
        if (sigma == 0).any():
            return math.inf
        return float(np.sqrt((((centre - point) / sigma) ** 2).sum()))


@dataclass
class Bfr:
    """Bradley-Fayyad-Reina clustering in n_chunks batches.

    Chunk 1: KMeans into 10 K clusters; clusters of at most 10 points are outliers and join the retained set (RS); KMeans
    into K of the others makes the discard sets (DS). Later chunks: a point joins the nearest DS within 1.5 sqrt(d), else
    the nearest compression set (CS) so, else RS. Whenever RS has over 10 K points, KMeans into 5 K turns its clusters of
    several points into CS. CS closer than 2 sqrt(d) are merged; after the last chunk a CS that close to a DS joins it."""

    k: int
    n_chunks: int = 5
    seed: int = 0
    rounds: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def _stats(self, rows: DataFrame, cluster: str) -> dict[int, _Set]:
        return {r.cluster: _Set(r.n, np.array(r.sums), np.array(r.squares)) for r in cluster_stats(rows, cluster).collect()}

    def _frame(self, spark, sets: dict[int, _Set]) -> DataFrame:
        rows = [(c, s.n, s.sums.tolist(), s.squares.tolist()) for c, s in sets.items()]
        return spark.createDataFrame(rows, "cluster int, n long, sums array<double>, squares array<double>")

    def fit(self, points: DataFrame) -> DataFrame:
        """pid, label: the DS of each point, -1 for what stayed outside. rounds: (round, DS points, CS, CS points, RS points)."""
        spark = points.sparkSession
        points = stored(chunks(points.select("pid", "features"), self.n_chunks).where("features is not null"), "points")
        if points.isEmpty():
            return spark.createDataFrame([], "pid long, label int")
        dims = points.select(F.max(F.size("features"))).first()[0]
        reach, merge = 1.5, 2 * math.sqrt(dims)
        large = 10 * self.k
        self.rounds, self._next, groups = [], 0, {}

        first = points.where("chunk = 1").select("pid", "features")
        fine = stored(self._labelled(first, large), "fine")
        small = fine.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n <= 10").select("label")
        kept = stored(fine.join(F.broadcast(small), "label", "left_anti").select("pid", "features"), "kept")
        retained = stored(fine.join(F.broadcast(small), "label", "left_semi").select("pid", "features"), "retained")
        labelled = stored(self._labelled(kept, self.k).select("pid", "features", "label"), "labelled")
        ds, cs = self._stats(labelled, "label"), {}
        assigned = labelled.select("pid", "label")
        compressed = spark.createDataFrame([], "pid long, cs int")
        retained, compressed = self._compress(retained, compressed, cs, large)
        self._report(1, ds, cs, retained)

        for number in range(2, self.n_chunks + 1):
            batch = points.where(F.col("chunk") == number).select("pid", "features")
            retained_before = retained
            if ds:
                met = stored(batch.join(nearest(batch, self._frame(spark, ds), reach), "pid"), "met")
                joined, rest = met.where("cluster is not null"), met.where("cluster is null").select("pid", "features")
                for c, s in self._stats(joined, "cluster").items():
                    ds[c].add(s)
                assigned = assigned.unionByName(joined.select("pid", F.col("cluster").alias("label")))
            else:
                rest = batch
            if cs:
                met = stored(rest.join(nearest(rest, self._frame(spark, cs), reach), "pid"), "met")
                joined, rest = met.where("cluster is not null"), met.where("cluster is null").select("pid", "features")
                for c, s in self._stats(joined, "cluster").items():
                    cs[c].add(s)
                compressed = compressed.unionByName(joined.select("pid", F.col("cluster").alias("cs")))
            retained = stored(retained_before.unionByName(rest), "retained")
            retained, compressed = self._compress(retained, compressed, cs, large)
            self._merge(cs, groups, merge)
            if number == self.n_chunks:
                into = {}
                for c in sorted(cs):
                    near = min(((ds[d].distance(cs[c].sums / cs[c].n), d) for d in ds), default=(math.inf, -1))
                    if near[0] < merge:
                        into[c] = near[1]
                for c, d in into.items():
                    ds[d].add(cs.pop(c))
                for c, d in {**groups}.items():
                    while d in groups:
                        d = groups[d]
                    if d in into:
                        into[c] = into[d]
                if into:
                    final = spark.createDataFrame(sorted(into.items()), "cs int, label int")
                    assigned = assigned.unionByName(compressed.join(F.broadcast(final), "cs").select("pid", "label"))
            self._report(number, ds, cs, retained)
        return points.select("pid").join(assigned, "pid", "left").select("pid", F.coalesce("label", F.lit(-1)).alias("label"))

    def _labelled(self, rows: DataFrame, k: int) -> DataFrame:
        n = rows.count()
        if n == 0:
            return rows.withColumn("label", F.lit(0))
        return kmeans(rows, max(2, min(k, n)), self.seed) if n > 1 and k > 1 else rows.withColumn("label", F.lit(0))

    def _compress(self, retained: DataFrame, compressed: DataFrame, cs: dict[int, _Set], large: int) -> tuple[DataFrame, DataFrame]:
        if retained.count() <= large:
            return retained, compressed
        grouped = stored(self._labelled(retained, large // 2), "grouped")
        several = grouped.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
        names = {r.label: self._next + i for i, r in enumerate(several.orderBy("label").collect())}
        self._next += len(names)
        if not names:
            return retained, compressed
        name_of = F.broadcast(retained.sparkSession.createDataFrame(sorted(names.items()), "label int, cs int"))
        inside = stored(grouped.join(name_of, "label").select("pid", "features", "cs"), "inside")
        cs |= self._stats(inside, "cs")
        return stored(grouped.join(name_of, "label", "left_anti").select("pid", "features"), "retained"), compressed.unionByName(inside.select("pid", "cs"))

    @staticmethod
    def _merge(cs: dict[int, _Set], groups: dict[int, int], limit: float) -> None:
        """Greedy, by ascending number; groups: where a merged set went."""
        names = sorted(cs)
        for i, a in enumerate(names):
            if a in cs:
                for b in names[i + 1 :]:
                    if b in cs and cs[a].distance(cs[b].sums / cs[b].n) < limit:
                        cs[a].add(cs.pop(b))
                        groups[b] = a

    def _report(self, number: int, ds: dict, cs: dict, retained: DataFrame) -> None:
        self.rounds.append((number, sum(s.n for s in ds.values()), len(cs), sum(s.n for s in cs.values()), retained.count()))


def confusion(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """truth, label, n."""
    return truth.select("pid", "truth").join(labels, "pid").groupBy("truth", "label").agg(F.count(F.lit(1)).alias("n"))


def rounds_frame(spark, rounds: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rounds, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")
