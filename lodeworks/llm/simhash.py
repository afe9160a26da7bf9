"""SimHash near-dedup with bit-sliced comparison.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; XXH64 (seed 42) of each 4-word shingle,
repeats included (fewer words: one shingle of all; no word: fingerprint zero); a bit is 1 if set in over half of the
hashes. Fingerprints with at most 4 different bits are linked; groups are the connected components.

Candidates: the 64 bits are cut into 6 blocks. At most 4 blocks of a linked pair can differ, so at least two agree:
each of the 15 pairs of blocks is a bucket key, and no link is lost. Distinct fingerprints alone are compared. In a
partition of buckets, windows of rows are compared with the rows up to the end of their last bucket: the latter's bits
are stored as 64 vertical planes, three planes at a time are added by carry-save to four bitwise counters, and a window is
abandoned once all its lanes exceed the radius. A partition reports a spanning forest of its links, never all pairs.
Buckets of over ``TILE`` fingerprints are cut into tiles, and the pairs of tiles are dealt to tasks, so that no task
holds a hot bucket. Components come from the library's star contraction, whose rounds are stored tables.

Defined cases: a null text has no words, so fingerprint zero; a null doc_id belongs to its group but is no one's
smallest id (a group of nulls only has component null); repeated rows are in one group; an empty table gives an empty
result; other columns play no part and are kept by ``drop_near_copies``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import bounded, stored, text_of
from lodeworks.operators.graph import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TILE = 20_000
#: Rows of a key from which on its entry is broadcast, where the others are joined by shuffle.
HOT = 100_000
WINDOW = 256


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends, starts = ends[SHINGLE - 1 :].tolist(), starts[: n - SHINGLE + 1].tolist()
    hash_of, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, total, 1 << 16):
        span = slice(at, at + (1 << 16))
        h = np.array([hash_of(joined[a:z], SEED) for a, z in zip(starts[span], ends[span])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def row_keys() -> list:
    """128 bits of (doc_id, text): equal for repeated rows alone."""
    text = text_of(F.col("text"))
    return [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("k2")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the row's key), fp (the 64 bits as a long)."""

    def kernel(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(3)], np.uint64).view(np.int64)
            columns = [*(batch.column(i) for i in range(3)), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), *row_keys(), "text")
    return rows.mapInArrow(kernel, "doc_id long, k1 long, k2 long, fp long")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """64 rows of packed lanes, 64 lanes a word: row b holds bit b of every fingerprint."""
    n = len(fp)
    words = -(-n // 64)
    padded = np.zeros(words * 64, "<u8")
    padded[:n] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of (query, lane) with at most ``radius`` (below 7) different bits, by bit-sliced counting."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    # One word a bit and query: all ones where the bit is set.
    wide = np.where((queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), ones, np.uint64(0))[:, :, None]
    shape = (len(queries), planes.shape[1])
    c1, c2, c4, over = (np.zeros(shape, np.uint64) for _ in range(4))

    def beyond():
        # Lanes whose count of 4*c4 + 2*c2 + c1 exceeds the radius.
        out = over.copy()
        for value in range(radius + 1, 8):
            hit = (c4 if value & 4 else ~c4) & (c2 if value & 2 else ~c2) & (c1 if value & 1 else ~c1)
            out |= hit
        return out

    for b in range(0, 63, 3):
        x, y, z = (planes[b + k][None, :] ^ wide[b + k] for k in range(3))
        xy = x ^ y
        low, high = xy ^ z, (x & y) | (xy & z)  # carry-save: three bits make a one and a two
        carry = c1 & low
        c1 ^= low
        both = high & carry
        high ^= carry  # twos to add: high or carry; both makes a four
        carry = c2 & high
        c2 ^= high
        fours = carry | both
        over |= c4 & fours
        c4 ^= fours
        if b % 12 == 9 and bool((beyond() == ones).all()):
            return np.empty(0, np.int64), np.empty(0, np.int64)
    x = planes[63][None, :] ^ wide[63]
    carry = c1 & x
    c1 ^= x
    high = c2 & carry
    c2 ^= carry
    over |= c4 & high
    c4 ^= high
    close = ~beyond()
    row, word = np.nonzero(close)
    bits = np.unpackbits(close[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, bit = np.nonzero(bits)
    i, j = row[hit], word[hit] * 64 + bit
    real = j < lanes
    return i[real], j[real]


def link_forest(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between rows of one key; rows are sorted by key."""
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    end = np.concatenate((np.flatnonzero(fresh)[1:], [n]))[np.cumsum(fresh) - 1]
    root, out_a, out_b = np.arange(n), [], []
    a = 0
    while a < n:
        z = min(n, a + WINDOW)
        e = int(end[z - 1])
        i, j = near(fp[a:z], planes_of(fp[a:e]), e - a, radius)
        keep = (j > i) & (key[a + i] == key[a + j])
        i, j = a + i[keep], a + j[keep]
        low = int(begin[a])
        while len(i):
            ri, rj = root[i], root[j]
            open_ = ri != rj
            if not open_.any():
                break
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            lo, hi = np.minimum(ri, rj), np.maximum(ri, rj)
            np.minimum.at(root, hi, lo)
            hooked = np.unique(hi)
            out_a.append(fp[hooked])
            out_b.append(fp[root[hooked]])
            part = root[low:e]
            while True:
                jumped = root[part]
                if (jumped == part).all():
                    break
                part[:] = jumped
        a = z
    if not out_a:
        return fp[:0], fp[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) pairs of linked fingerprints that connect what lies within the radius. distinct: fp, each once."""
    bits = F.col("fp")
    block = [F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    keys = F.array(*[
        F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
    ])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    hot = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE), "hot")
    if hot.isEmpty():
        dealt = rows.withColumn("tile", F.lit(0).cast("long"))
    else:
        tiles = bounded(hot.select("key", F.ceil(F.col("n") / TILE).cast("long").alias("tiles")))
        wide = rows.join(tiles, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
        other = wide.select("fp", "key", "tiles", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
        dealt = other.select("fp", "key", (F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")).alias("tile"))

    def kernel(batches):
        # A partition holds whole buckets, sorted; a bucket (tile pair) is at most two tiles.
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            if not held:
                return None
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            tile = table.column("tile").to_numpy()
            fp = table.column("fp").to_numpy()
            same = (key[1:] == key[:-1]) & (tile[1:] == tile[:-1])
            # The last bucket may go on in the next batch.
            cut = len(key) if last else int(np.flatnonzero(np.concatenate(([True], ~same)))[-1])
            held = [] if cut == len(key) else table.slice(cut).to_batches()
            size = len(key) - cut
            group = np.concatenate(([0], np.cumsum(~same)))[:cut]
            paired = np.concatenate(([False], same[: cut - 1])) | np.concatenate((same[: cut - 1], [False])) if cut > 1 else np.zeros(cut, bool)
            a, b = link_forest(group[paired], fp[:cut][paired].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 200_000:
                out = flush(False)
                if out is not None and out.num_rows:
                    yield out
        out = flush(True)
        if out is not None and out.num_rows:
            yield out

    sorted_rows = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return sorted_rows.select("key", "tile", "fp").mapInArrow(kernel, "a long, b long").distinct()


def met(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """rows joined by key with stored entries (key, n: its number of rows, ...): those of over HOT rows by broadcast, as these are few, the others by shuffle."""
    every, hot = entries.drop("n"), entries.where(F.col("n") > HOT).drop("n")
    if hot.isEmpty():
        return rows.join(every, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(every, key))


def groups(prints: DataFrame) -> DataFrame:
    """doc_id, k1, k2, fp, c (the group), component_id (the smallest doc_id of the group). prints: stored fingerprints."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    linked = links(distinct.select("fp")).toDF("src", "dst")
    member = stored(components(linked).select(F.col("node").alias("fp"), F.col("component").alias("c")), "members")
    in_group = stored(member.join(distinct, "fp"), "linked")
    smallest = stored(in_group.groupBy("c").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    few, rows = bounded(smallest), in_group.select("fp", "c", F.col("n").alias("rows"))
    named = (met(rows, smallest, "c") if few is smallest else rows.join(few.drop("n"), "c")).select("fp", "c", "component_id", F.col("rows").alias("n"))
    alone = distinct.join(member.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("c"), F.col("first_id").alias("component_id"), "n")
    return met(prints, stored(named.unionByName(alone), "groups"), "fp")


def group_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return groups(stored(fingerprints(docs), "fingerprints")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: that with the smallest doc_id (ids before nulls; ties by the row's hash)."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    prints = stored(fingerprints(docs), "fingerprints")
    kept = stored(groups(prints).groupBy("c").agg(best.alias("best")).select("best.k1", "best.k2"), "kept")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys())
    rows = whole.join(kept.hint("shuffle_hash"), ["k1", "k2"], "left_semi")
    # The key is unique but for repeated rows, of which one stays.
    if not prints.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = rows.dropDuplicates(["k1", "k2"])
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
