"""Communities by repeated removal of the edges of largest betweenness, at the largest modularity.

Betweenness and removal never cross components, so each component's removal sequence is found apart: those of at most
``KERNEL_EDGES`` edges each by one task's kernel, larger ones all together by rounds of the graph operators, whose every round is
distributed and stored (no task or driver holds such a component, but each round costs a betweenness of all pairs, so time
grows with the number of rounds). The sequences (one row a round of a component: its largest betweenness, the
change of modularity) are then merged into global rounds, largest value first, values within epsilon together. The
merge needs them in one place: it is a single task over rows of four numbers, at most one row an edge. The first global
round with the largest modularity decides how many rounds of each component count; what stays connected then is a community.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.graph import both_ways, components, edge_betweenness
from lodeworks.storage import remove, stored

EPSILON = 1e-10
#: Edges of a component up to which one task finds its removals.
KERNEL_EDGES = 20_000


def edge_credits(around: dict) -> dict:
    """Twice the betweenness of each edge (a < b) of an adjacency: shortest paths over ordered pairs."""
    credit: dict = defaultdict(float)
    for root in around:
        depth, paths, order = {root: 0}, {root: 1.0}, [root]
        for u in order:
            for v in around[u]:
                if v not in depth:
                    depth[v], paths[v] = depth[u] + 1, 0.0
                    order.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] += paths[u]
        value = dict.fromkeys(order, 1.0)
        for u in reversed(order):
            for v in around[u]:
                if depth[v] == depth[u] - 1:
                    share = value[u] * paths[v] / paths[u]
                    credit[(u, v) if u < v else (v, u)] += share
                    value[v] += share
    return credit


def pieces_of(around: dict, nodes) -> list[set]:
    out, seen = [], set()
    for start in nodes:
        if start not in seen:
            piece, stack = {start}, [start]
            while stack:
                for v in around[stack.pop()]:
                    if v not in piece:
                        piece.add(v)
                        stack.append(v)
            seen |= piece
            out.append(piece)
    return out


def removal_rounds(edges: list[tuple], degree: dict, m: int) -> list[tuple[float, list[tuple], float]]:
    """(largest betweenness, removed edges, modularity of this component's pieces afterwards) until no edge is left."""
    around = defaultdict(set)
    for u, v in edges:
        around[u].add(v)
        around[v].add(u)
    original = set(edges)

    def part(piece):
        inside = sum(1 for u, v in original if u in piece and v in piece)
        k, k2 = sum(degree[x] for x in piece), sum(degree[x] ** 2 for x in piece)
        return (2 * inside - (k * k - k2) / (2 * m)) / (2 * m)

    # Pieces keep their credits until an edge of theirs goes.
    state = []
    for piece in pieces_of(around, sorted(around)):
        state.append((piece, edge_credits({u: around[u] for u in piece}), part(piece)))
    out = []
    while any(credit for _, credit, _ in state):
        most = max(max(credit.values()) for _, credit, _ in state if credit)
        gone, now = [], []
        for piece, credit, q in state:
            mine = [e for e, c in credit.items() if abs(c - most) < 2 * EPSILON]
            if not mine:
                now.append((piece, credit, q))
                continue
            gone += mine
            for u, v in mine:
                around[u].discard(v)
                around[v].discard(u)
            for small in pieces_of(around, sorted(piece)):
                now.append((small, edge_credits({u: around[u] for u in small}), part(small)))
        state = now
        out.append((most / 2, sorted(gone), sum(q for _, _, q in state)))
    return out


def best_rounds(rows: pd.DataFrame) -> dict:
    """Rounds that count of each component. rows: component, step (from 0: before any removal), value, q."""
    sequences = {c: g.sort_values("step") for c, g in rows.groupby("component")}
    values = {c: g["value"].tolist() for c, g in sequences.items()}
    qs = {c: g["q"].tolist() for c, g in sequences.items()}
    done = dict.fromkeys(values, 0)
    heap = [(-v[1], c) for c, v in values.items() if len(v) > 1]
    heapq.heapify(heap)
    total = sum(q[0] for q in qs.values())
    best, at = -1.0, dict(done)
    while heap:
        if total > best:
            best, at = total, dict(done)
        most, popped = -heap[0][0], []
        while heap and abs(-heap[0][0] - most) < EPSILON:
            popped.append(heapq.heappop(heap)[1])
        for c in popped:
            total += qs[c][done[c] + 1] - qs[c][done[c]]
            done[c] += 1
            if done[c] + 1 < len(values[c]):
                heapq.heappush(heap, (-values[c][done[c] + 1], c))
    return at


def piece_sums(edges: DataFrame, left: DataFrame, degree: DataFrame, m: int) -> DataFrame:
    """component, q: modularity of the pieces that the edges left make of each component. edges: component, src, dst; degree: component, node, k."""
    named = components(left.select("src", "dst"))
    piece = stored(degree.join(named.withColumnRenamed("component", "c"), "node", "left").select("component", "node", "k", F.coalesce("c", "node").alias("piece")), "pieces")
    ends = [piece.select(F.col("node").alias(end), F.col("piece").alias(f"{end}_piece")) for end in ("src", "dst")]
    inside = edges.join(ends[0], "src").join(ends[1], "dst").groupBy("component").agg(F.count_if(F.col("src_piece") == F.col("dst_piece")).alias("inside"))
    each = piece.groupBy("component", "piece").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    sums = each.groupBy("component").agg(F.sum(F.col("k") * F.col("k") - F.col("k2")).alias("s"))
    return inside.join(sums, "component").select("component", ((2 * F.col("inside") - F.col("s") / (2 * m)) / (2 * m)).alias("q"))


def removals_by_rounds(edges: DataFrame, degree: DataFrame, m: int) -> DataFrame:
    """The rows of the kernel (component, step, value, q, src, dst) of components of any size. edges: component, src, dst, stored."""
    columns = ["component", "step", "value", "q", "src", "dst"]
    kind = dict(edges.dtypes)["src"]
    none = [F.lit(None).cast(kind).alias(c) for c in ("src", "dst")]
    out = stored(piece_sums(edges, edges, degree, m).select("component", F.lit(0).alias("step"), F.lit(0.0).alias("value"), "q", *none), "removed")
    left, step = edges, 0
    while not left.isEmpty():
        step += 1
        scored = stored(edge_betweenness(left.select("src", "dst")).join(left, ["src", "dst"]), "scored")
        most = scored.groupBy("component").agg(F.max("betweenness").alias("value"))
        gone = stored(scored.join(most, "component").where(F.col("value") - F.col("betweenness") < EPSILON).select("component", "src", "dst", "value"), "gone")
        rest = stored(left.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select("component", "src", "dst"), "rest")
        now = gone.join(piece_sums(edges, rest, degree, m), "component").select("component", F.lit(step).alias("step"), "value", "q", "src", "dst")
        grown = stored(out.select(columns).unionByName(now), "removed")
        for old in [out, scored, gone, *([left] if left is not edges else [])]:
            remove(old)
        out, left = grown, rest
    return out.select(columns)


def communities(edges: DataFrame) -> DataFrame:
    """community (its smallest node), members (sorted array) at the largest modularity. An empty graph has none."""
    edges = stored(edges, "edges")
    kind = dict(edges.dtypes)["src"]
    m = edges.count()
    if not m:
        return edges.sparkSession.createDataFrame([], f"community {kind}, members array<{kind}>")
    degree = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    named = stored(components(edges), "components")
    labelled = stored(edges.join(named.withColumnRenamed("node", "src"), "src").select("component", "src", "dst"), "labelled")
    large = stored(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > KERNEL_EDGES).select("component"), "large")  # at most m / KERNEL_EDGES rows
    small = labelled.join(F.broadcast(large), "component", "left_anti")
    full = small.join(degree.select(F.col("node").alias("src"), F.col("k").alias("k1")), "src").join(degree.select(F.col("node").alias("dst"), F.col("k").alias("k2")), "dst")

    def remove_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["src"].tolist(), pdf["dst"].tolist()))
        sizes = dict(zip(pdf["src"].tolist(), pdf["k1"].tolist())) | dict(zip(pdf["dst"].tolist(), pdf["k2"].tolist()))
        nodes = set(sizes)
        k, k2 = sum(sizes.values()), sum(x * x for x in sizes.values())
        start = (2 * len(pairs) - (k * k - k2) / (2 * m)) / (2 * m)
        component = min(nodes)
        # Step 0 stands for the whole component and carries no edge.
        rows = [(component, 0, 0.0, start, None, None)]
        for step, (value, gone, q) in enumerate(removal_rounds(pairs, sizes, m), 1):
            rows += [(component, step, value, q, u, v) for u, v in gone]
        return pd.DataFrame(rows, columns=["component", "step", "value", "q", "src", "dst"]).astype({"src": "object", "dst": "object"})

    removed = full.groupBy("component").applyInPandas(remove_edges, f"component {kind}, step int, value double, q double, src {kind}, dst {kind}")
    if not large.isEmpty():
        wide = stored(labelled.join(F.broadcast(large), "component", "left_semi").select("component", "src", "dst"), "wide")
        own = degree.join(named, "node").join(F.broadcast(large), "component", "left_semi").select("component", "node", "k")
        removed = removed.unionByName(removals_by_rounds(wide, stored(own, "degrees"), m))
    removed = stored(removed, "removed")
    steps = removed.groupBy("component", "step").agg(F.first("value").alias("value"), F.first("q").alias("q"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = best_rounds(pdf)
        return pd.DataFrame({"component": list(found), "keep": list(found.values())})

    keep = steps.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(merge, f"component {kind}, keep int")
    left = stored(removed.where("step > 0").join(keep, "component").where("step > keep").select("src", "dst"), "left")
    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct()
    member = nodes.join(components(left), "node", "left").select("node", F.coalesce("component", "node").alias("community"))
    return member.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("members"))
