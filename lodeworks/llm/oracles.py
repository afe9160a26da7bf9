"""DuckDB SQL for the queries that SQL can express."""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP9 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k
GROUP BY doc_id
"""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op8(template_rows: list[tuple], min_percent: int) -> str:
    """template_rows: (template, licence, size, first word, second word, times)."""
    values = ",\n    ".join(f"({t}, '{name}', {size}, '{a}', '{b}', {n})" for t, name, size, a, b, n in template_rows)
    return f"""
WITH known(template, licence, size, w1, w2, times) AS (
  VALUES {values}
), texts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS t FROM documents
), units AS (
  SELECT doc_id, generate_subscripts(us, 1) AS unit, unnest(us) AS u
  FROM (SELECT doc_id, CASE WHEN len(ls) > 1 THEN list_append(ls, t) ELSE ls END AS us FROM texts)
), worded AS (
  SELECT doc_id, unit, regexp_extract_all(lower(u), '[a-z0-9]+') AS w FROM units
), sized AS (
  SELECT doc_id, unit, w, len(w) - 1 AS n FROM worded
  WHERE len(w) > 1 AND EXISTS (SELECT 1 FROM known WHERE 200 * least(len(w) - 1, size) >= {min_percent} * (len(w) - 1 + size))
), numbered AS (
  SELECT doc_id, unit, n, w, unnest(range(1, n + 1)) AS i FROM sized
), pairs AS (
  SELECT doc_id, unit, n, w[i] AS a, w[i + 1] AS b, count(*) AS seen FROM numbered GROUP BY ALL
), scored AS (
  SELECT doc_id, unit, template, licence, n + size AS total, sum(least(seen, times)) AS common
  FROM pairs JOIN known ON a = w1 AND b = w2 GROUP BY doc_id, unit, template, licence, n, size
), hits AS (
  SELECT *, round(2 * common / total, 6) AS dice FROM scored WHERE 200 * common >= {min_percent} * total
), best AS (
  SELECT doc_id, count(DISTINCT unit) AS n_units, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences,
         max(dice) AS best_dice, arg_min(licence, struct_pack(d := -dice, l := licence)) AS best_licence
  FROM hits GROUP BY doc_id
)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(licences, '') AS licences,
       coalesce(best_licence, '') AS best_licence, coalesce(best_dice, 0.0) AS best_dice
FROM documents LEFT JOIN best USING (doc_id)
"""


OP6 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), fives AS (
  SELECT *, list_transform(range(0, 8), lambda j:
    CAST(list_sum(list_transform(range(1, 6), lambda i:
      (instr('0123456789abcdef', substr(h, 5 * j + i, 1)) - 1) * CAST(power(16, 5 - i) AS BIGINT))) AS BIGINT)) AS v
  FROM p
), digested AS (
  SELECT page_id, payload_bytes, h,
         array_to_string(list_transform(v, lambda x:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY h) AS top
  FROM fives
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM digested
"""
