import random
from collections import deque

import pytest

from pyspark.sql import functions as F

from lodeworks.functions import pairing
from lodeworks.operators import communities, graph, recommend

TRIANGLES = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def brute_betweenness(edges):
    around = {}
    for u, v in edges:
        around.setdefault(u, set()).add(v)
        around.setdefault(v, set()).add(u)

    def bfs(s):
        d, n, q = {s: 0}, {s: 1}, deque([s])
        while q:
            u = q.popleft()
            for v in around[u]:
                if v not in d:
                    d[v], n[v] = d[u] + 1, 0
                    q.append(v)
                if d[v] == d[u] + 1:
                    n[v] += n[u]
        return d, n

    reach = {s: bfs(s) for s in around}
    out = {}
    for u, v in edges:
        total = 0.0
        for s in around:
            for t in around:
                ds, ns = reach[s]
                if s < t and t in ds and u in ds:
                    for a, b in ((u, v), (v, u)):
                        dt, nt = reach[t]
                        if ds[a] + 1 + dt[b] == ds[t]:
                            total += ns[a] * nt[b] / ns[t]
        out[u, v] = total
    return out


def scores(df):
    return {(r.src, r.dst): r.betweenness for r in df.collect()}


def test_edges_need_shared_items(spark):
    rows = [(u, i) for u, items in {1: range(8), 2: range(1, 8), 3: range(2, 8), 4: [None]}.items() for i in items]
    df = spark.createDataFrame([*rows, (3, 2), (3, 2)], "u long, i long")
    assert {(r.src, r.dst) for r in graph.co_occurrence_edges(df, "u", "i", 7).collect()} == {(1, 2)}


def test_path(spark):
    assert scores(graph.edge_betweenness(frame(spark, [(0, 1), (1, 2), (2, 3)]))) == {(0, 1): 3, (1, 2): 4, (2, 3): 3}


def test_triangles(spark):
    found = scores(graph.edge_betweenness(frame(spark, TRIANGLES)))
    assert found == {(2, 3): 9, (0, 2): 4, (1, 2): 4, (3, 4): 4, (3, 5): 4, (0, 1): 1, (4, 5): 1}
    assert {(r.src, r.dst) for r in graph.largest_edges(graph.edge_betweenness(frame(spark, TRIANGLES))).collect()} == {(2, 3)}


def test_random_graph(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(18), 2))) for _ in range(26)})
    assert scores(graph.edge_betweenness(frame(spark, edges))) == pytest.approx(brute_betweenness(edges))


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [tuple(sorted(rng.sample(range(60), 2))) for _ in range(30)]
    found = {r.node: r.component for r in graph.components(frame(spark, edges)).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert found == label


def test_modularity(spark):
    edges = frame(spark, TRIANGLES)
    one = spark.createDataFrame([(i, 0) for i in range(6)], "node long, component long")
    two = spark.createDataFrame([(i, 3 * (i // 3)) for i in range(6)], "node long, component long")
    q = graph.modularity(edges, one).first()
    assert (round(q.q, 6), round(q.textbook_q, 6)) == (0.173469, 0.0)
    q = graph.modularity(edges, two).first()
    assert (round(q.q, 6), round(q.textbook_q, 6)) == (0.530612, 0.357143)


def test_communities(spark):
    found = {r.community: r.members for r in communities.communities(frame(spark, TRIANGLES)).collect()}
    assert found == {0: [0, 1, 2], 3: [3, 4, 5]}


def plain_communities(edges):
    """All edges of largest betweenness go at once; the first best modularity counts."""
    m, left = len(edges), list(edges)
    nodes = sorted({x for e in edges for x in e})
    degree = {x: sum(x in e for e in edges) for x in nodes}

    def parts():
        label = {x: x for x in nodes}
        for _ in nodes:
            for u, v in left:
                label[u] = label[v] = min(label[u], label[v])
        return label

    best, kept = -1, None
    while left:
        label = parts()
        q = sum(((min(u, v), max(u, v)) in set(edges)) - degree[u] * degree[v] / 2 / m for u in nodes for v in nodes if u != v and label[u] == label[v]) / 2 / m
        if q > best + 1e-12:
            best, kept = q, label
        score = brute_betweenness(left)
        most = max(score.values())
        left = [e for e in left if abs(score[e] - most) >= 1e-9]
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_communities_of_several_components(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(a, a + 9), 2))) for a in (0, 20, 40) for _ in range(14)})
    expected = {}
    for node, label in plain_communities(edges).items():
        expected.setdefault(label, []).append(node)
    found = {r.community: r.members for r in communities.communities(frame(spark, edges)).collect()}
    assert found == expected


def test_components_too_large_for_a_kernel(spark, monkeypatch):
    """The same communities by rounds, where a bound sends two of three components there, a hub among them."""
    hub = [(100, 101 + i) for i in range(6)]
    edges = TRIANGLES + [(10, 11), (11, 12)] + hub
    expected = {r.community: r.members for r in communities.communities(frame(spark, edges)).collect()}
    assert expected[0] == [0, 1, 2] and expected[3] == [3, 4, 5]
    for bound in (5,):
        monkeypatch.setattr(communities, "KERNEL_EDGES", bound)
        assert {r.community: r.members for r in communities.communities(frame(spark, edges)).collect()} == expected


def test_empty_graph(spark):
    empty = frame(spark, [])
    assert graph.edge_betweenness(empty).count() == 0
    assert graph.components(empty).count() == 0
    assert communities.communities(empty).count() == 0
    assert graph.modularity(empty, spark.createDataFrame([], "node long, component long")).count() == 0


def test_a_hot_item_is_paired_in_tiles(spark, monkeypatch):
    """An item of all nodes: the same edges, and no task pairs all its rows."""
    monkeypatch.setattr(pairing, "TILE", 10)
    rng = random.Random(6)
    rows = [(u, 0) for u in range(60)] + [(rng.randrange(60), rng.randrange(1, 12)) for _ in range(400)] + [(None, 3), (7, None)]
    df = spark.createDataFrame(rows, "u long, i long").repartition(3)
    items = {}
    for u, i in rows:
        if u is not None and i is not None:
            items.setdefault(u, set()).add(i)
    expected = {(a, b): len(items[a] & items[b]) for a in items for b in items if a < b and items[a] & items[b]}
    assert {(r.src, r.dst): r.n for r in graph.co_occurrences(df, "u", "i").collect()} == expected
    pairs = pairing.sharing(df.where("u is not null").distinct(), "i", "u", [F.col("u").alias("a")], [F.col("u").alias("b")])
    # As on large tables: no broadcast, no merging of small partitions.
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        tasks = pairs.where("i = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 3600 and max(r["count"] for r in tasks) < 3600


def test_ratings_of_a_hot_entity(spark, monkeypatch):
    monkeypatch.setattr(pairing, "TILE", 5)
    rng = random.Random(7)
    rated = {(u, i): float(rng.randrange(1, 6)) for u in range(25) for i in (0, rng.randrange(1, 8))}
    df = spark.createDataFrame([(*k, s) for k, s in rated.items()], "user long, item long, stars double")
    tiled = {(r.a, r.b): r.w for r in recommend.cosine(df, None, "user", "item").collect()}
    monkeypatch.setattr(pairing, "TILE", 1000)
    assert tiled == pytest.approx({(r.a, r.b): r.w for r in recommend.cosine(df, None, "user", "item").collect()}) and len(tiled) == 300
