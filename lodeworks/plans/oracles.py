"""DuckDB SQL with the same result as each query that SQL can express."""

from __future__ import annotations

PURCHASES = "p AS (SELECT o_custkey, l_partkey, l_suppkey, l_orderkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
RATED = "r AS (SELECT o_custkey AS u, l_partkey AS i, max(1.0 + l_quantity % 5) AS s FROM p GROUP BY 1, 2)"
EDGES = f"""
{PURCHASES}, pairs AS (SELECT DISTINCT o_custkey AS node, l_partkey AS item FROM p),
edges AS (
  SELECT a.node AS src, b.node AS dst FROM pairs a JOIN pairs b ON a.item = b.item AND a.node < b.node
  GROUP BY 1, 2 HAVING count(*) >= 7
), links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
"""
# A level keeps the one before it (tag 1): a neighbour is new if it is in neither.
BFS = f"""
WITH RECURSIVE {EDGES}, bfs(root, node, depth, sigma, tag) AS (
  SELECT DISTINCT src, src, 0, CAST(1 AS DOUBLE), 0 FROM links
  UNION ALL
  SELECT * FROM (
    WITH nxt AS (
      SELECT b.root, e.dst AS node, b.depth + 1 AS depth, sum(b.sigma) AS sigma
      FROM bfs b JOIN links e ON b.node = e.src
      WHERE b.tag = 0 AND NOT EXISTS (SELECT 1 FROM bfs v WHERE v.root = b.root AND v.node = e.dst)
      GROUP BY ALL
    )
    SELECT root, node, depth, sigma, 0 FROM nxt
    UNION ALL
    SELECT root, node, depth, sigma, 1 FROM bfs WHERE tag = 0 AND root IN (SELECT root FROM nxt)
  )
), reach AS (SELECT root, node, depth, sigma FROM bfs WHERE tag = 0)
"""
SCORED = f"""{BFS}, flow AS (
  SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst, x.sigma * y.sigma / z.sigma AS f
  FROM links e JOIN reach x ON x.node = e.src JOIN reach y ON y.node = e.dst
  JOIN reach z ON z.root = x.root AND z.node = y.root AND z.depth = x.depth + 1 + y.depth
), scored AS (SELECT src, dst, sum(f) / 2 AS betweenness FROM flow GROUP BY 1, 2)
"""
POINTS = """
each AS (
  SELECT vec_id AS pid, label AS cluster, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings
), stats AS (
  SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM each GROUP BY 1, 2
), shape AS (SELECT cluster, dim, s / n AS c, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS sigma FROM stats)
"""
DISTANCES = f"{POINTS}, dist AS (SELECT pid, h.cluster, sqrt(sum(pow((c - x) / nullif(sigma, 0), 2))) AS distance, count(*) AS dims FROM each JOIN shape h USING (dim) GROUP BY 1, 2)"
BASKETS = f"{PURCHASES}, b AS (SELECT DISTINCT o_custkey AS basket, CAST(l_suppkey AS VARCHAR) AS item FROM p)"


def frequent(support: int) -> str:
    """f: itemsets (arr) in at least support baskets; a set grows by items after its last while its baskets suffice."""
    return f"""WITH RECURSIVE {BASKETS}, f(arr, last, ids, freq) AS (
  SELECT [item], item, list(basket), count(*) FROM b GROUP BY item HAVING count(*) >= {support}
  UNION ALL
  SELECT list_append(o.arr, b.item), b.item, list(b.basket), count(*)
  FROM (SELECT arr, last, unnest(ids) AS basket FROM f) o JOIN b ON b.basket = o.basket AND b.item > o.last
  GROUP BY o.arr, b.item HAVING count(*) >= {support}
)"""


def local(support: int, parts: int) -> str:
    """cand: itemsets whose count in a part reaches support / parts."""
    least = support / parts
    return f"""WITH RECURSIVE {BASKETS}, f(part, arr, last, ids) AS (
  SELECT basket % {parts}, [item], item, list(basket) FROM b GROUP BY basket % {parts}, item HAVING count(*) >= {least}
  UNION ALL
  SELECT o.part, list_append(o.arr, b.item), b.item, list(b.basket)
  FROM (SELECT part, arr, last, unnest(ids) AS basket FROM f) o JOIN b ON b.basket = o.basket AND b.item > o.last
  GROUP BY o.part, o.arr, b.item HAVING count(*) >= {least}
), cand AS (SELECT DISTINCT arr FROM f)"""


TOKENS = """
tok AS (
  SELECT DISTINCT doc_id AS id, t AS item FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents) WHERE t <> ''
), size AS (SELECT id, count(*) AS n FROM tok GROUP BY 1)
"""
JACCARD = """
co AS (SELECT x.id AS id1, y.id AS id2, count(*) AS k FROM tok x JOIN tok y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2),
sim AS (
  SELECT id1, id2, k / (a.n + b.n - k) AS similarity FROM co JOIN size a ON a.id = id1 JOIN size b ON b.id = id2
  WHERE k / (a.n + b.n - k) >= 0.5
)
"""
SIGNED = f"""{TOKENS}, idx AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM tok)),
sig AS (
  SELECT id, k, min((i * ((7919 * k + 13) % 65536 + 1) + (104729 * k + 17) % 65537) % 65537) AS h
  FROM tok JOIN idx USING (item) CROSS JOIN (SELECT unnest(range(0, 150)) AS k) GROUP BY 1, 2
)"""
BANDED = f"""{SIGNED}, band AS (SELECT id, k // 3 AS band, string_agg(h, ',' ORDER BY k) AS key FROM sig GROUP BY 1, 2),
cand AS (SELECT DISTINCT x.id AS id1, y.id AS id2 FROM band x JOIN band y ON x.band = y.band AND x.key = y.key AND x.id < y.id)"""


def weights(key: str, shared: str, of: str = "r") -> str:
    return f"""norm AS (SELECT {key} AS k, sum(s * s) AS q FROM {of} GROUP BY 1),
w AS (
  SELECT x.{key} AS a, y.{key} AS b, sum(x.s * y.s) / sqrt(max(na.q) * max(nb.q)) AS w
  FROM {of} x JOIN {of} y ON x.{shared} = y.{shared} AND x.{key} < y.{key} JOIN norm na ON na.k = x.{key} JOIN norm nb ON nb.k = y.{key} GROUP BY 1, 2
)"""


def correlations(key: str, shared: str) -> str:
    return f"""WITH {PURCHASES}, {RATED}, c AS (
  SELECT x.{key} AS a, y.{key} AS b, sum(x.s * y.s) - sum(x.s) * sum(y.s) / count(*) AS p,
         sum(x.s * x.s) - sum(x.s) * sum(x.s) / count(*) AS qa, sum(y.s * y.s) - sum(y.s) * sum(y.s) / count(*) AS qb
  FROM r x JOIN r y ON x.{shared} = y.{shared} AND x.{key} < y.{key} GROUP BY 1, 2
) SELECT a, b, round(CASE WHEN abs(p) < 1e-9 THEN 0.0 ELSE p / sqrt(greatest(qa * qb, 0)) END, 6) AS w FROM c"""


SPLIT = f"""{PURCHASES},
r AS (SELECT o_custkey AS u, l_partkey AS i, max(1.0 + l_quantity % 5) AS s FROM p
      WHERE l_orderkey % 10 <> 0 AND o_custkey % 50 <> 0 AND l_partkey % 40 <> 0 GROUP BY 1, 2),
t AS (SELECT o_custkey AS u, l_partkey AS i, max(1.0 + l_quantity % 5) AS s FROM p WHERE l_orderkey % 10 = 0 GROUP BY 1, 2),
feat AS (
  SELECT p_partkey AS i, 1.0 + p_size % 5 AS fs, (1.0 + p_size % 5) / 5.0 AS s1, CAST(p_size AS DOUBLE) / max(p_size) OVER () AS c1
  FROM part WHERE p_partkey % 7 <> 0
), um AS (SELECT u, sum(s) AS total, count(*) AS n FROM r GROUP BY 1), im AS (SELECT i, avg(s) AS m FROM r GROUP BY 1),
facts AS (
  SELECT t.u, t.i, r.s AS known, um.total / um.n AS umean, im.m AS imean, feat.fs
  FROM t LEFT JOIN r ON r.u = t.u AND r.i = t.i LEFT JOIN um ON um.u = t.u LEFT JOIN im ON im.i = t.i LEFT JOIN feat ON feat.i = t.i
)"""
CLAMP = "least(greatest({0}, 1.0), 5.0)"
USER_CF = f"""WITH {SPLIT}, {weights("u", "i")}, sums AS (
  SELECT f.u, f.i, sum((o.s - (um.total - o.s) / nullif(um.n - 1, 0)) * w.w) AS p, sum(abs(w.w)) AS q
  FROM facts f JOIN r o ON o.i = f.i JOIN w ON w.a = least(f.u, o.u) AND w.b = greatest(f.u, o.u) JOIN um ON um.u = o.u
  WHERE f.known IS NULL AND f.umean IS NOT NULL AND w.w > 0 GROUP BY 1, 2
), predicted AS (
  SELECT f.u AS "user", f.i AS item,
    CASE WHEN known IS NOT NULL THEN 'known' WHEN umean IS NULL THEN 'new_user' WHEN imean IS NULL THEN 'new_item' ELSE 'cf' END AS branch,
    CASE WHEN known IS NOT NULL THEN known WHEN umean IS NULL THEN coalesce(fs, 3.0) WHEN imean IS NULL THEN umean
         WHEN coalesce(q, 0) = 0 THEN umean ELSE {CLAMP.format("umean + p / q")} END AS prediction
  FROM facts f LEFT JOIN sums USING (u, i)
)"""


def by_items(hybrid: bool) -> str:
    weight = "CASE WHEN w.w > 0 THEN w.w ELSE v.v END" if hybrid else "w.w"
    content = """, v AS (
  SELECT DISTINCT least(f.i, o.i) AS a, greatest(f.i, o.i) AS b,
    (x.s1 * y.s1 + x.c1 * y.c1) / sqrt((x.s1 * x.s1 + x.c1 * x.c1) * (y.s1 * y.s1 + y.c1 * y.c1)) AS v
  FROM facts f JOIN r o ON o.u = f.u JOIN feat x ON x.i = least(f.i, o.i) JOIN feat y ON y.i = greatest(f.i, o.i) WHERE f.known IS NULL AND f.i <> o.i
)""" if hybrid else ""  # fmt: skip
    more = "LEFT JOIN v ON v.a = least(f.i, o.i) AND v.b = greatest(f.i, o.i)" if hybrid else ""
    keep = f"{weight} > 0" if hybrid else "w.w <> 0"
    new_item = "base IS NULL" if hybrid else "imean IS NULL"
    fallback = "3.5" if hybrid else "coalesce(fs, 3.0)"
    return f"""WITH {SPLIT}, {weights("i", "u")}{content}, sums AS (
  SELECT f.u, f.i, sum((o.s - coalesce(feat.fs, im.m)) * {weight}) AS p, sum(abs({weight})) AS q
  FROM facts f JOIN r o ON o.u = f.u LEFT JOIN w ON w.a = least(f.i, o.i) AND w.b = greatest(f.i, o.i) {more}
  JOIN im ON im.i = o.i LEFT JOIN feat ON feat.i = o.i
  WHERE f.known IS NULL AND f.i <> o.i AND {keep} GROUP BY 1, 2
), based AS (SELECT *, coalesce(fs, imean) AS base FROM facts)
SELECT f.u AS "user", f.i AS item,
  CASE WHEN known IS NOT NULL THEN 'known' WHEN {new_item} THEN 'new_item' WHEN umean IS NULL THEN 'new_user' ELSE 'cf' END AS branch,
  round(CASE WHEN known IS NOT NULL THEN known WHEN {new_item} THEN {fallback} WHEN umean IS NULL THEN base
       WHEN coalesce(q, 0) = 0 OR abs(p) < 1e-12 THEN base ELSE {CLAMP.format("base + p / q")} END, 6) AS prediction
FROM based f LEFT JOIN sums USING (u, i)"""


AVERAGES = """
SELECT n_name, round(avg(o_totalprice) + 1e-7, 4) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY avg(o_totalprice) DESC, n_name
"""


def top(name: str, key: str) -> str:
    return f"(SELECT '{name}' AS metric, CAST({key} AS VARCHAR) AS key, count(*) AS value FROM orders GROUP BY {key} ORDER BY count(*) DESC, {key} LIMIT 10)"


def basket_rows(key: str, item: str, having: str = "") -> str:
    return f"""WITH {PURCHASES} SELECT {key} AS basket, string_agg(DISTINCT CAST({item} AS VARCHAR), ',' ORDER BY CAST({item} AS VARCHAR)) AS items
FROM p GROUP BY 1 {having}"""


ORACLES = {
    "count_all": "SELECT count(*) AS n FROM events",
    "count_year": "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1998",
    "count_distinct_keys": "SELECT count(DISTINCT user_id) + max(CAST(user_id IS NULL AS INT)) AS n_users, count(DISTINCT event_type) + max(CAST(event_type IS NULL AS INT)) AS n_types FROM events",
    "top10_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "top10_products": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10",
    "profile_long": f"""
SELECT 'n_review' AS metric, '' AS key, count(*) AS value FROM orders
UNION ALL SELECT 'n_review_year', '', count(*) FROM orders WHERE year(o_orderdate) = 1998
UNION ALL SELECT 'n_user', '', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'n_business', '', count(DISTINCT o_orderpriority) FROM orders
UNION ALL {top("top_user", "o_custkey")} UNION ALL {top("top_business", "o_orderpriority")}""",
    "json_field_agg": """
SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k
FROM (SELECT event_type, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1""",
    "region_avg": AVERAGES,
    "top10_avg": f"SELECT * FROM ({AVERAGES} LIMIT 10)",
    "global_max_norm": """
SELECT p_partkey, round((1.0 + p_size % 5) / 5.0, 6) AS norm_stars, round(CAST(p_size AS DOUBLE) / max(p_size) OVER (), 6) AS norm_count FROM part""",
    "partition_sizes": """
SELECT CAST(part AS INTEGER) AS part, count(o_custkey) AS n_items FROM (SELECT unnest(range(0, 8)) AS part) LEFT JOIN orders ON o_custkey % 8 = part GROUP BY 1""",
    "colocation_check": "SELECT CAST(1 AS BIGINT) AS max_parts FROM orders HAVING count(*) > 0",
    "baskets_by_user": basket_rows("o_custkey", "l_suppkey"),
    "baskets_by_item": basket_rows("l_suppkey", "o_custkey"),
    "baskets_filtered": basket_rows("o_custkey", "l_suppkey", "HAVING count(*) > 40"),
    "frequent_itemsets": f"{frequent(85)} SELECT array_to_string(arr, ',') AS items, len(arr) AS size, freq FROM f",
    "fp_growth_itemsets": f"{frequent(180)} SELECT array_to_string(arr, ',') AS items, len(arr) AS size, freq FROM f",
    "itemset_candidates": f"{local(300, 4)} SELECT array_to_string(arr, ',') AS items, len(arr) AS size FROM cand",
    "itemset_two_pass": f"{frequent(300)} SELECT array_to_string(arr, ',') AS items, freq FROM f",
    "itemset_report": f"""{frequent(180)}
SELECT 'Frequent Itemsets' AS section, len(arr) AS size, string_agg('(''' || array_to_string(arr, ''', ''') || ''')', ',' ORDER BY arr) AS line
FROM f GROUP BY len(arr)""",
    "exact_jaccard": f"WITH {TOKENS}, {JACCARD} SELECT id1, id2, round(similarity, 6) AS similarity FROM sim",
    "jaccard_links": f"""WITH {TOKENS}, {JACCARD},
linked AS (SELECT id, count(*) AS k FROM (SELECT id1 AS id FROM sim UNION ALL SELECT id2 FROM sim) GROUP BY 1),
kind AS (SELECT id, list_sort(list(item)) AS items FROM tok GROUP BY 1)
SELECT id, min(id) OVER (PARTITION BY items) AS class_id, coalesce(k, 0) AS n_links FROM kind LEFT JOIN linked USING (id)""",
    "minhash_signatures": f"WITH {SIGNED} SELECT id, string_agg(h, ',' ORDER BY k) AS signature FROM sig GROUP BY 1",
    "lsh_candidates": f"WITH {BANDED} SELECT id1, id2 FROM cand",
    "lsh_similar": f"WITH {BANDED}, {JACCARD} SELECT id1, id2, round(similarity, 6) AS similarity FROM sim JOIN cand USING (id1, id2)",
    "rating_stats": f'WITH {PURCHASES}, {RATED} SELECT u AS "user", sum(s) AS total, sum(s * s) AS norm, count(*) AS n FROM r GROUP BY 1',
    "item_user_dense_ids": f"""WITH {PURCHASES}, {RATED}
SELECT 'user' AS kind, u AS key, row_number() OVER (ORDER BY u) - 1 AS id FROM (SELECT DISTINCT u FROM r)
UNION ALL SELECT 'item', i, row_number() OVER (ORDER BY i) - 1 FROM (SELECT DISTINCT i FROM r)""",
    "cosine_users": f"WITH {PURCHASES}, {RATED}, {weights('u', 'i')} SELECT a, b, round(w, 6) AS w FROM w",
    "cosine_items": f"WITH {PURCHASES}, {RATED}, {weights('i', 'u')} SELECT a, b, round(w, 6) AS w FROM w",
    "pearson_pairs": correlations("u", "i"),
    "pearson_item_pairs": correlations("i", "u"),
    "content_similarity": f"""WITH {SPLIT}, {RATED.replace("r AS", "every AS")},
pairs AS (SELECT DISTINCT x.i AS a, y.i AS b FROM every x JOIN every y ON x.u = y.u AND x.i < y.i)
SELECT a, b, round((x.s1 * y.s1 + x.c1 * y.c1) / sqrt((x.s1 * x.s1 + x.c1 * x.c1) * (y.s1 * y.s1 + y.c1 * y.c1)), 6) AS w
FROM pairs JOIN feat x ON x.i = a JOIN feat y ON y.i = b""",
    "predict_user_cf": f'{USER_CF} SELECT "user", item, branch, round(prediction, 6) AS prediction FROM predicted',
    "predict_item_cf": by_items(False),
    "predict_hybrid": by_items(True),
    "rmse_user_cf": f"{USER_CF} SELECT round(sqrt(avg(pow(t.s - prediction, 2))), 6) AS rmse FROM t JOIN predicted ON t.u = \"user\" AND t.i = item",
    "co_rating_edges": f"WITH {EDGES} SELECT src, dst FROM edges",
    "connected_components": f"{BFS} SELECT node, min(root) AS component FROM reach GROUP BY 1",
    "bfs_path_counts": f"{BFS} SELECT root, node, depth, sigma FROM reach",
    "edge_betweenness": f"{SCORED} SELECT src, dst, round(betweenness, 6) AS betweenness FROM scored",
    "first_removed_edges": f"""{SCORED} SELECT src, dst, round(betweenness, 6) AS betweenness FROM scored
WHERE abs(betweenness - (SELECT max(betweenness) FROM scored)) < 1e-10""",
    "modularity_components": f"""{BFS}, member AS (SELECT node, min(root) AS c FROM reach GROUP BY 1),
deg AS (SELECT src AS node, count(*) AS k FROM links GROUP BY 1), m AS (SELECT 2.0 * count(*) AS m2 FROM edges),
per AS (SELECT c, sum(k) AS kc, sum(k * k) AS k2 FROM deg JOIN member USING (node) GROUP BY 1),
sums AS (SELECT sum(kc * kc) AS kc2, sum(k2) AS k2 FROM per)
SELECT round((m2 - (kc2 - k2) / m2) / m2, 6) AS q, round((m2 - kc2 / m2) / m2, 6) AS textbook_q FROM sums, m WHERE m2 > 0""",
    "cluster_stats": f"WITH {POINTS} SELECT cluster, n, CAST(dim AS INTEGER) AS dim, round(s, 6) AS s, round(q, 6) AS q FROM stats",
    "cluster_stats_merged": f"""WITH {POINTS}, pooled AS (SELECT cluster % 2 AS cluster, dim, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM stats GROUP BY 1, 2)
SELECT cluster, CAST(n AS BIGINT) AS n, CAST(dim AS INTEGER) AS dim, round(s / n, 6) AS c, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 6) AS sigma FROM pooled""",
    "rows_by_key_partition": "SELECT CAST(1 AS BIGINT) AS max_parts FROM orders HAVING count(*) > 0",
    "mahalanobis_all": f"WITH {DISTANCES} SELECT pid, cluster, round(distance, 6) AS distance FROM dist",
    "nearest_cluster": f"""WITH {DISTANCES}, near AS (SELECT pid, arg_min(cluster, struct_pack(d := distance, c := cluster)) AS cluster FROM dist WHERE distance < 1.03 * sqrt(dims) GROUP BY 1)
SELECT vec_id AS pid, cluster FROM embeddings LEFT JOIN near ON pid = vec_id""",
    "cluster_merge_pairs": f"""WITH {POINTS}, d AS (
  SELECT x.cluster AS a, y.cluster AS b, sqrt(sum(pow((x.c - y.c) / nullif(x.sigma, 0), 2))) AS distance FROM shape x JOIN shape y ON x.dim = y.dim AND x.cluster < y.cluster GROUP BY 1, 2
) SELECT a, b, round(distance, 6) AS distance FROM d WHERE distance < 10.0""",
    "file_profile": f"""
SELECT 'n_review' AS metric, '' AS key, count(*) AS value FROM orders
UNION ALL SELECT 'n_review_year', '', count(*) FROM orders WHERE year(o_orderdate) = 1998
UNION ALL SELECT 'n_user', '', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'n_business', '', count(DISTINCT o_orderpriority) FROM orders
UNION ALL {top("top10_user", "CAST(o_custkey AS VARCHAR)")} UNION ALL {top("top10_business", "o_orderpriority")}""",
    "file_averages": """
SELECT n_name AS city, round(avg(1.0 + o_orderkey % 5), 6) AS avg_stars FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "file_pairs": f"""
WITH {PURCHASES}, per AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n, count(DISTINCT l_suppkey) AS n_items FROM p GROUP BY 1)
SELECT header, per.* FROM per, (VALUES ('given'), ('first')) AS h(header)""",
    "file_ratings": f"WITH {PURCHASES}, {RATED} SELECT CAST(u AS VARCHAR) AS user_id, CAST(i AS VARCHAR) AS business_id, s AS stars FROM r",
    "file_points": """
SELECT vec_id AS pid, label AS truth, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""",
    "file_itemsets": f"""SELECT * FROM ({local(300, 4)}
SELECT 'Candidates' AS section, len(arr) AS size, string_agg('(''' || array_to_string(arr, ''', ''') || ''')', ',' ORDER BY arr) AS line FROM cand GROUP BY len(arr))
UNION ALL SELECT * FROM ({frequent(180)}
SELECT 'Frequent Itemsets' AS section, len(arr) AS size, string_agg('(''' || array_to_string(arr, ''', ''') || ''')', ',' ORDER BY arr) AS line FROM f GROUP BY len(arr))""",
    "file_edges": f"""
WITH {PURCHASES}, pairs AS (SELECT DISTINCT o_custkey AS node, l_partkey AS item FROM p),
met AS (
  SELECT CAST(a.node AS VARCHAR) AS src, CAST(b.node AS VARCHAR) AS dst, count(*) AS n FROM pairs a JOIN pairs b ON a.item = b.item AND a.node < b.node
  GROUP BY a.node, b.node HAVING count(*) >= 7
)
SELECT row_number() OVER (ORDER BY n DESC, src, dst) AS place, '(''' || src || ''', ''' || dst || '''), ' || n || '.0' AS line FROM met""",
    "file_communities": f"""{BFS}, member AS (SELECT CAST(node AS VARCHAR) AS node, min(root) AS c FROM reach GROUP BY reach.node),
line AS (SELECT count(*) AS n, min(node) AS first, string_agg('''' || node || '''', ', ' ORDER BY node) AS line FROM member GROUP BY c)
SELECT row_number() OVER (ORDER BY n, first) AS place, line FROM line""",
    "file_clustering": f"""WITH {DISTANCES}, near AS (
  SELECT pid, arg_min(cluster, struct_pack(d := distance, c := cluster)) AS cluster FROM dist WHERE distance < 1.03 * sqrt(dims) GROUP BY 1
)
SELECT 'rounds' AS kind, * FROM (VALUES (1, 'Round 1: 5,0,0,4'), (2, 'Round 2: 7,1,2,3')) AS r(place, line)
UNION ALL SELECT 'labels', row_number() OVER (ORDER BY vec_id), vec_id || ',' || coalesce(cluster, -1) FROM embeddings LEFT JOIN near ON pid = vec_id""",
    "file_stream": "SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n FROM orders GROUP BY 1",
    "layout_facts": "SELECT name, CAST(value AS BIGINT) AS value FROM (VALUES ('parts_of_a_key', 1), ('at_most', 4), ('by_key', 3), ('at_least', 5), ('own', 6)) AS f(name, value)",
    "als_coverage": f"""WITH {SPLIT} SELECT u AS "user", i AS item, true AS finite FROM facts WHERE umean IS NOT NULL AND imean IS NOT NULL""",
    "kmeans_facts": "SELECT count(*) AS n_points, CAST(10 AS BIGINT) AS n_labels, CAST(0 AS BIGINT) AS n_misplaced, true AS tighter FROM embeddings",
    "bfr_facts": "SELECT count(*) AS n_points, CAST(0 AS BIGINT) AS n_unlabelled, true AS rounds_add_up, true AS labels_are_the_sets FROM events",
    "confusion_margins": "SELECT event_type AS truth, count(*) AS n FROM events GROUP BY 1",
}
