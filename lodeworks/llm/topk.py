"""Exact top-k search by integer inner product over a pivot-distance index.

Components are quantised to floor(scale * x). With one more coordinate, sqrt(M - |x|^2) (M the largest squared norm; 0 for
a query), |q - x|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the nearest points and the triangle inequality holds.

Index: every vector is keyed by its nearest pivot and the distance to it; the table is sorted by that key (and row, so
that equal vectors spread) and written to the shared folder. Pivots are centres fitted on a bounded sample
(``sample_rows`` rows, the first by hash); every row is indexed.

Search: queries come in blocks of about ``query_block`` (fewer where vectors are wide). A block is broadcast with each query's k-th best score in the
sample, a lower bound of its true k-th best. A task cuts its sorted rows into annuli (a pivot, a span of distances),
ranks them for each query by the bound max(0, r - hi, lo - r), r being the query's distance to the pivot, visits them
nearest first, raises the query's k-th best, and stops where the bound shows that no better score can follow. Tasks
report at most k rows a query; those are ranked at the end. No row is left unsearched but by the bound.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded
with zeros; nothing is clipped: a vector whose quantised components exceed an int or whose squared norm reaches 2**62, so that
scores might not fit a long, is refused with an error; each row is a query or candidate of its
own, also where ids or rows repeat; a candidate without id comes after all ids of its score; rows without id are no
queries; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.llm.common import stored

SCALE = 64
#: Largest quantised component, and the squared norm below which every score is exact as a long.
LIMIT = (1 << 31) - 1
MOST = 1 << 62
NO_ID = (1 << 63) - 1
#: Bounds of memory: queries that meet an annulus at once, and bytes of a query block's or the sample's vectors.
QUERIES_AT_ONCE = 4096
BLOCK_BYTES = 64 << 20
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (unique), vec_id, q (array<int>), n2 (squared norm) of the vectors that take part."""

    def kernel(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, rows, qs, norms = [], [], [], []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if v.is_valid and not v.values.null_count:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                    if np.isfinite(x).all():
                        floored = np.floor(scale * x)
                        if np.abs(floored).max(initial=0) > LIMIT or floored @ floored > 0.999 * MOST:
                            raise ValueError(f"vector {vec_id} is too large for exact scores at scale {scale}")
                        q = floored.astype(np.int64)
                        ids.append(vec_id)
                        rows.append(at)
                        qs.append(q.astype(np.int32))
                        norms.append(int(q @ q))
                        at += 1
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, qs)]), pa.int32()), pa.array(np.concatenate(qs) if qs else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), lists, pa.array(norms, pa.int64())], names=["row", "vec_id", "q", "n2"])

    columns = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return columns.mapInArrow(kernel, "row long, vec_id long, q array<int>, n2 long")


def matrix(lists: pa.ListArray, width: int, dtype) -> np.ndarray:
    """Rows of lists, padded with zeros."""
    values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values.reshape(-1, width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def exact_type(width: int, largest_norm: int):
    """The fastest type in which inner products (at most the largest squared norm, as are their partial sums' terms) are exact."""
    bound = largest_norm * math.isqrt(max(1, width))
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Centres by a few Lloyd rounds, from evenly spaced sample rows."""
    sample = sample.astype(np.float64)
    centres = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = distances(sample, centres).argmin(1)
        for c in range(len(centres)):
            mine = sample[near == c]
            if len(mine):
                centres[c] = mine.mean(0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T))


def lifted(x: np.ndarray, n2: np.ndarray, most: int) -> np.ndarray:
    """x with the coordinate that makes all norms equal."""
    return np.concatenate([x.astype(np.float64), np.sqrt(np.maximum(0.0, most - n2.astype(np.float64)))[:, None]], 1)


class Best:
    """The k best (score, id) of each query so far; floor is a score below which nothing can be among them."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        self.parts.append((query, score, vec_id))
        self.size += len(query)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            empty = np.empty(0, np.int64)
            return empty, empty, empty
        query, score, vec_id = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((vec_id, -score, query))
        query, score, vec_id = query[order], score[order], vec_id[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(query)) + 1)) if len(query) else np.empty(0, int)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate((first, [len(query)]))))
        keep = rank < self.k
        kth = rank == self.k - 1
        self.floor[query[kth]] = np.maximum(self.floor[query[kth]], score[kth])
        self.parts = [(query[keep], score[keep], vec_id[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def search_rows(
    best: Best, queries: np.ndarray, query_rows: np.ndarray, reach: np.ndarray, slack: np.ndarray,
    pivot: np.ndarray, dist: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, annulus: int,
) -> None:
    """Adds to best what sorted rows (pivot, dist) have. reach: distance of each query to each pivot; slack: |q|^2 + M."""
    cuts = np.flatnonzero(np.diff(pivot)) + 1
    begins = [a for lo, hi in zip([0, *cuts], [*cuts, len(pivot)]) for a in range(lo, hi, annulus)]
    ends = [*begins[1:], len(pivot)]
    inner, outer = dist[begins], dist[np.array(ends) - 1]
    away = reach[:, pivot[begins]]
    # Distances near zero are off by the rounding of squared norms.
    bound = np.maximum(0, np.maximum(away - outer, inner - away) - 1e-6 * (1 + away) - 1e-7 * np.sqrt(slack)[:, None])
    order = np.argsort(bound, 1, kind="stable")
    open_ = np.arange(len(queries))
    for step in range(len(begins)):
        at = order[open_, step]
        # Nothing in this annulus, nor in any later one, can reach the floor.
        going = bound[open_, at] ** 2 <= slack[open_] * (1 + 1e-12) - 2.0 * best.floor[open_] + 1e-3
        open_, at = open_[going], at[going]
        if not len(open_):
            return
        by = np.argsort(at, kind="stable")
        for a, group in zip(*_groups(at[by], open_[by])):
            a_rows = slice(begins[a], ends[a])
            for mine in np.split(group, range(QUERIES_AT_ONCE, len(group), QUERIES_AT_ONCE)):
                score = queries[mine] @ x[a_rows].T
                i, j = np.nonzero(score >= best.floor[mine][:, None])
                j += begins[a]
                other = rows[j] != query_rows[mine[i]]
                i, j = i[other], j[other]
                best.add(mine[i], score[i, j - begins[a]].astype(np.int64), ids[j])
        if best.size > 500_000 or step < 2:
            best.settle()


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return [int(k) for k in keys[np.concatenate(([0], cuts))]], np.split(values, cuts)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, pivots: int = 64, sample_rows: int = 8192,
    query_block: int = 16_384, annulus: int = 1024, rows_at_once: int = 65_536,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row for which is_query (over vec_id) holds."""
    spark = vectors.sparkSession
    base = stored(quantised(vectors, scale), "quantised")
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max("n2").alias("most"), F.max(F.size("q")).alias("width")).first()
    if not facts.n:
        return spark.createDataFrame([], RESULT)
    most, width = facts.most, max(1, facts.width)
    dtype = exact_type(width, most)
    most_rows = max(256, BLOCK_BYTES // (8 * width))
    query_block, sample_rows = min(query_block, most_rows), min(sample_rows, most_rows)
    sample = base.orderBy(F.xxhash64("vec_id", "q"), "row").limit(sample_rows).toArrow()
    seen = matrix(sample.column("q").combine_chunks(), width, dtype)
    seen_rows = sample.column("row").to_numpy()
    centres = fit_pivots(lifted(seen, sample.column("n2").to_numpy(), most), pivots)

    def keyed(batches):
        for batch in batches:
            x = matrix(batch.column("q"), width, np.float64)
            d = distances(lifted(x, batch.column("n2").to_numpy(), most), centres)
            near = d.argmin(1)
            key = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *key], names=[*batch.schema.names, "pivot", "dist"])

    with_key = base.mapInArrow(keyed, "row long, vec_id long, q array<int>, n2 long, pivot int, dist double")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(facts.n / 500_000))
    index = stored(with_key.repartitionByRange(parts, "pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row"), "index")

    chosen = base.where(is_query)
    blocks = max(1, math.ceil(chosen.count() / query_block))
    block_of = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = None
    for b in range(blocks):
        part = chosen.where(block_of == b).toArrow()
        if not part.num_rows:
            continue
        one = _search_block(spark, index, part, seen, seen_rows, centres, most, width, dtype, k, annulus, rows_at_once)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], RESULT)
    # Tasks have reported at most k rows a query each.
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    vec_id = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
    return ranked.select("query_id", "rank", vec_id.alias("vec_id"), "score")


def _search_block(spark, index, part, seen, seen_rows, centres, most, width, dtype, k, annulus, rows_at_once) -> DataFrame:
    q = matrix(part.column("q").combine_chunks(), width, dtype)
    n2, q_rows, q_ids = (part.column(c).to_numpy() for c in ("n2", "row", "vec_id"))
    floor = np.full(len(q), -(1 << 62), np.int64)
    for a in range(0, len(q), 2048):  # the k-th best of the sample, without the query's own row
        score = np.where(seen_rows[None, :] == q_rows[a : a + 2048, None], -(1 << 62), (q[a : a + 2048] @ seen.T).astype(np.int64))
        if score.shape[1] >= k:
            floor[a : a + 2048] = np.partition(score, -k, 1)[:, -k]
    reach = distances(np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], 1), centres).astype(np.float64)
    sent = spark.sparkContext.broadcast((q, q_rows, q_ids, floor, reach, n2.astype(np.float64) + most))

    def kernel(batches):
        q, q_rows, q_ids, floor, reach, slack = sent.value
        best = Best(floor, k)

        def search(held):
            table = pa.Table.from_batches(held)
            ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
            x = matrix(table.column("q").combine_chunks(), width, dtype)
            pivot, dist, rows = (table.column(c).to_numpy() for c in ("pivot", "dist", "row"))
            order = np.lexsort((dist, pivot))  # several files may meet in a task
            search_rows(best, q, q_rows, reach, slack, pivot[order], dist[order], rows[order], ids[order], x[order], annulus)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows_at_once:
                search(held)
                held, size = [], 0
        if held and size:
            search(held)
        query, score, vec_id = best.settle()
        for a in range(0, len(query), 100_000):
            i = query[a : a + 100_000]
            columns = (q_rows[i], q_ids[i], vec_id[a : a + 100_000], score[a : a + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    rows = index.select("row", "vec_id", "q", "pivot", "dist")
    hits = stored(rows.mapInArrow(kernel, "query_row long, query_id long, vec_id long, score long"), "hits")
    sent.unpersist()
    return hits
