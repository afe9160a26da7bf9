"""Graphs of co-occurrence: edges, components, shortest-path counts, edge betweenness, modularity.

Edges are (src < dst). Every round of a loop is a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.pairing import sharing
from lodeworks.storage import remove, stored


def co_occurrences(df: DataFrame, node: str, item: str) -> DataFrame:
    """src < dst, n: the number of distinct items that two nodes share: an equi-join on the item, hot items in tiles. Null nodes and items play no part."""
    rows = stored(df.select(F.col(node).alias("node"), F.col(item).alias("item")).where("node is not null and item is not null").distinct(), "pairs")
    met = sharing(rows, "item", "node", [F.col("node").alias("src")], [F.col("node").alias("dst")])
    return met.where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def co_occurrence_edges(df: DataFrame, node: str, item: str, least: int = 7) -> DataFrame:
    """src, dst of nodes that share at least ``least`` distinct items."""
    return co_occurrences(df, node, item).where(F.col("n") >= least).select("src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node), of every node with an edge.

    Alternating large-star and small-star contraction: a number of rounds that grows with the logarithm of the size, not
    with the diameter; ends when a round changes nothing."""

    def mark(pairs):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("v", "c"), F.lit(1 << 40)))).first()

    pairs = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("c")).distinct(), "edges")
    last = mark(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("c").alias("v"), F.col("v").alias("c")))
        least = both.groupBy("v").agg(F.min("c").alias("m")).select("v", F.least("v", "m").alias("m"))
        # Large star: larger neighbours of v go to v's minimum.
        large = both.where("c > v").join(least, "v").select(F.col("c").alias("v"), F.col("m").alias("c")).where("v <> c").distinct()
        # Small star: v and its smaller neighbours go to the smallest of them.
        low = large.groupBy("v").agg(F.min("c").alias("m"))
        small = large.join(low, "v").select(F.col("c").alias("v"), F.col("m").alias("c")).where("v <> c")
        now = stored(small.unionByName(low.select("v", F.col("m").alias("c"))).distinct(), "edges")
        remove(pairs)
        pairs, new = now, mark(now)
        if new == last:
            named = pairs.unionByName(pairs.select(F.col("c").alias("v"), "c").distinct())
            return named.select(F.col("v").alias("node"), F.col("c").alias("component"))
        last = new
    raise RuntimeError("components did not settle")


def path_counts(edges: DataFrame, roots: DataFrame | None = None) -> list[DataFrame]:
    """Breadth-first levels from all nodes (or the given roots, column root) at once: root, node, sigma (shortest paths), by depth."""
    links = stored(both_ways(edges), "links")
    nodes = links.select(F.col("src").alias("root")).distinct() if roots is None else roots
    levels = [stored(nodes.select("root", F.col("root").alias("node"), F.lit(1.0).alias("sigma")), "level")]
    while True:
        ahead = levels[-1].join(links, F.col("node") == F.col("src")).groupBy("root", "dst").agg(F.sum("sigma").alias("sigma"))
        ahead = ahead.select("root", F.col("dst").alias("node"), "sigma")
        # A neighbour of this level lies in the next one unless it lies in this one or the one before.
        for seen in levels[-2:]:
            ahead = ahead.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        level = stored(ahead, "level")
        if level.isEmpty():
            return levels
        levels.append(level)


def bfs_table(edges: DataFrame) -> DataFrame:
    """root, node, depth, sigma."""
    out = None
    for depth, level in enumerate(path_counts(edges)):
        rows = level.select("root", "node", F.lit(depth).alias("depth"), "sigma")
        out = rows if out is None else out.unionByName(rows)
    return out


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """src, dst, betweenness: shortest paths through each edge, over unordered pairs of nodes.

    Credit flows from the deepest level up: a node passes 1 plus what it got to its parents by their share of paths."""
    edges = stored(edges, "edges")
    links = both_ways(edges)
    levels = path_counts(edges)
    out, credit = None, None
    for depth in range(len(levels) - 1, 0, -1):
        own = levels[depth].withColumnRenamed("sigma", "paths")
        if credit is not None:
            own = own.join(credit, ["root", "node"], "left")
            own = own.select("root", "node", "paths", (1 + F.coalesce("got", F.lit(0.0))).alias("value"))
        else:
            own = own.withColumn("value", F.lit(1.0))
        up = own.join(links, F.col("node") == F.col("src")).select("root", "node", "paths", "value", F.col("dst").alias("parent"))
        above = levels[depth - 1].select("root", F.col("node").alias("parent"), "sigma")
        flow = stored(up.join(above, ["root", "parent"]).select("root", "node", "parent", (F.col("value") * F.col("sigma") / F.col("paths")).alias("f")), "flow")
        credit = flow.groupBy("root", F.col("parent").alias("node")).agg(F.sum("f").alias("got"))
        part = flow.groupBy(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst")).agg(F.sum("f").alias("f"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return edges.select("src", "dst", F.lit(0.0).alias("betweenness"))
    return out.groupBy("src", "dst").agg((F.sum("f") / 2).alias("betweenness"))


def largest_edges(scored: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """The edges within epsilon of the largest betweenness."""
    most = scored.agg(F.max("betweenness").alias("most"))
    return scored.crossJoin(F.broadcast(most)).where(F.abs(F.col("betweenness") - F.col("most")) < epsilon).select("src", "dst", "betweenness")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """q (pairs u <> v alone) and textbook_q of a partition (node, component), from sums a community. No row for an empty graph."""
    ends = both_ways(edges)
    degree = ends.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    inside = (
        edges.join(members.select(F.col("node").alias("src"), F.col("component").alias("c1")), "src")
        .join(members.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst")
        .where("c1 = c2").agg(F.count(F.lit(1)).alias("e"))
    )
    each = degree.join(members, "node").groupBy("component").agg(F.sum("k").alias("kc"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    sums = each.agg(F.sum(F.col("kc") * F.col("kc")).alias("kc2"), F.sum("k2").alias("k2"))
    m2 = edges.agg((2.0 * F.count(F.lit(1))).alias("m2"))
    q = (2 * F.col("e") - (F.col("kc2") - F.col("k2")) / F.col("m2")) / F.col("m2")
    plain = (2 * F.col("e") - F.col("kc2") / F.col("m2")) / F.col("m2")
    one = inside.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(m2)).where("m2 > 0")
    return one.select(q.alias("q"), plain.alias("textbook_q"))
