import math
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import topk
from lodeworks.llm.oracles import OP1
from tests.compare import connect, difference
from tests.llm.fixtures import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def is_query():
    return F.col("vec_id") % 20 == 0


def plain(rows, k):
    """(query id, rank, vec_id, score) of all queries; rows are one another's candidates by place."""
    width = max((len(v) for _, v, _ in rows if v), default=0)
    used = []
    for i, v, _ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, [math.floor(64 * x) for x in v] + [0] * (width - len(v))))
    out = []
    for a, (i, q) in enumerate(used):
        if i is not None and i % 20 == 0:
            scored = [(-sum(x * y for x, y in zip(q, c)), j is None, j or 0, j) for b, (j, c) in enumerate(used) if b != a]
            out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def rows_of(seed, n, dims=6, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(round(c + rng.gauss(0, spread), 3)) for c in rng.choice(centres)], 0) for i in range(n)]


def same(spark, rows, k=5, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    exact = [(i, None if v is None else list(v), c) for i, v, c in df.collect()]
    found = topk.top_k(df, is_query(), k=k, **settings)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain(exact, k), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain(spark, seed):
    same(spark, rows_of(seed, 300, spread=0.1), pivots=7, sample_rows=40, annulus=16, query_block=6, rows_at_once=64)


def test_odd_rows(spark):
    rows = rows_of(3, 60)
    rows += [(20, rows[0][1], 1), (20, rows[0][1], 1), (40, rows[5][1], 2)]  # repeated ids and rows
    rows += [(k, [0.25] * 6, 0) for k in range(1000, 1080)]  # one vector many times: ties by id
    rows += [(None, rows[1][1], 0), (None, None, None), (2000, None, 0), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2040, [float("nan")] * 6, 0), (2060, [float("inf")] * 6, 0)]
    rows += [(2080, [1.0, 2.0], 0), (2100, [], 0), (-20, [0.5] * 6, 0), (2120, [3e4] * 6, 0)]
    same(spark, rows, k=7, pivots=4, sample_rows=16, annulus=8)


def test_fewer_candidates_than_k(spark):
    same(spark, rows_of(4, 4), k=20)
    same(spark, rows_of(4, 1), k=20)


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), is_query()).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), is_query()).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame(rows_of(5, 50), SCHEMA).withColumns({c: F.lit("x") for c in ("row", "q", "n2", "pivot", "dist", "score", "rank", "query_id")})
    assert topk.top_k(df, is_query(), k=3).count() == 9


def test_equals_sql(spark):
    found = topk.top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), is_query())
    assert difference(found, connect(SF).sql(OP1)) == ""


def test_bounds_stop_the_search():
    """In clustered data most annuli are never visited."""
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(0, 40, (8, 4))
    x = np.floor(centres[np.repeat(np.arange(8), 500)] + rng.normal(0, 1, (4000, 4))).astype(np.int64)
    n2 = (x * x).sum(1)
    most = int(n2.max())
    up = topk.lifted(x, n2, most)
    pivots = topk.fit_pivots(up, 32)
    d = topk.distances(up, pivots)
    pivot = d.argmin(1)
    order = np.lexsort((d.min(1), pivot))
    visited = []

    class Counting(topk.Best):
        def add(self, query, score, vec_id):
            visited.append(len(query))
            super().add(query, score, vec_id)

    q = x[:20].astype(np.float64)
    best = Counting(np.full(20, -(1 << 62)), 5)
    reach = topk.distances(np.concatenate([q, np.zeros((20, 1))], 1), pivots)
    topk.search_rows(best, q, np.arange(20), reach, n2[:20] + most, pivot[order], d.min(1)[order], order, order, x[order].astype(np.float64), 50)
    query, score, _ = best.settle()
    for i in range(20):
        own = np.sort(np.delete(x @ x[i], i))[::-1][:5]
        assert score[query == i].tolist() == own.tolist()
    assert sum(visited) < 20 * 4000 / 2


def test_large_components_are_exact(spark):
    """Beyond 2**28 after quantising, and scores beyond 2**53."""
    for seed, size in ((6, 5e6), (7, 1e6)):
        rows = [(i, [x * size for x in v], c) for i, v, c in rows_of(seed, 200, spread=0.1)]
        rows += [(1000 + k, [size * 1.5] * 6, 0) for k in range(30)]
        same(spark, rows, k=7, pivots=5, sample_rows=40, annulus=8)


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(20, [1e12, 1.0], 0), (21, [1.0, 1.0], 0)], SCHEMA)
    with pytest.raises(Exception, match="too large for exact scores"):
        topk.top_k(df, is_query(), k=1).collect()


def test_exact_scores_of_large_vectors(spark):
    rows = [(0, [5e6, 1.0], 0), (1, [6e6, 0.0], 0), (2, [4.5e6, 1.0], 0)]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), is_query()).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(1, 1, 122880000000000000), (2, 2, 92160000000004096)]


def test_many_dimensions(spark):
    """256 of them, with some components of 5e6: exact; with all of them so: refused, as no long holds the scores."""
    rng = random.Random(9)
    rows = [(i, [rng.choice((5e6, -5e6)) if k % 32 == 0 else float(rng.randrange(-99, 99)) for k in range(256)], 0) for i in range(80)]
    same(spark, rows, k=6, pivots=4, sample_rows=16, annulus=8)
    with pytest.raises(Exception, match="too large for exact scores"):
        topk.top_k(spark.createDataFrame([(20, [5e6] * 256, 0)], SCHEMA), is_query()).collect()
