"""Jaccard similarity of token sets: exact join with prefix filter, and MinHash with banding.

Sets are (id, items): one row an id, items an array of any one type. Tokens are compared as 64-bit hashes; sets with equal
items are one class, found by a 128-bit hash, and only classes are compared.

Defined cases: null items and repeated ones within a set play no part; a set without items (or with null for items) is similar
to nothing and has no row in any result; equal sets of different ids are pairs of similarity 1; other columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import MODULUS, coefficients, dense_ids
from lodeworks.operators import setblocks
from lodeworks.storage import bounded, remove, stored

BANDS, ROWS = 50, 3
#: Sets from which on a token is hot: there are few such tokens, so they are broadcast where the dictionary is not.
HOT = 100_000


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens between spaces."""
    return F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda t: t != ""))


def token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, items of the rows whose text (null: none) has a token."""
    # Not a filter on the tokens, which would make them twice.
    return df.where(F.col(text).rlike("[^ ]")).select(F.col(key).alias("id"), tokens(F.col(text)).alias("items"))


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets with equal items are one class: the stored (id, codes) of each class's smallest id, and the membership (id, rep)."""
    codes = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    coded = stored(sets.select("id", codes.alias("codes")).where(F.col("id").isNotNull()), "coded")
    keyed = coded.where(F.size("codes") > 0).select("*", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit(1), F.col("codes")).alias("h2"))
    reps = stored(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep")), "classes")
    # Only hashes and ids travel; skewed classes are split by the join.
    member = stored(keyed.select("id", "h1", "h2").join(reps, ["h1", "h2"]).select("id", "rep"), "members")
    copies = bounded(member.where(F.col("id") != F.col("rep")).select("id"))
    single = stored(coded.where(F.size("codes") > 0).join(copies, "id", "left_anti").select("id", "codes"), "representatives")
    remove(coded)
    return single, member


def expanded(found: DataFrame, member: DataFrame) -> DataFrame:
    """id1 < id2, similarity of all ids, from pairs of representatives and the membership."""
    one = member.select(F.col("rep").alias("id1"), F.col("id").alias("x"))
    two = member.select(F.col("rep").alias("id2"), F.col("id").alias("y"))
    across = found.join(one, "id1").join(two, "id2").select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), "similarity")
    inside = one.join(two, F.col("id1") == F.col("id2")).where("x < y").select(F.col("x").alias("id1"), F.col("y").alias("id2"), F.lit(1.0).alias("similarity"))
    return across.unionByName(inside)


def link_counts(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """id, class_id, n_links (sets of at least the threshold, its own left out) of every set; copies are not expanded to pairs."""
    reps, member = classes(sets)
    found = representative_pairs(reps, threshold)
    size = member.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    both = found.select(F.col("id1").alias("rep"), F.col("id2").alias("other")).unionByName(found.select(F.col("id2").alias("rep"), F.col("id1").alias("other")))
    other = both.join(size.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("links"))
    counts = size.join(other, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return member.join(counts, "rep").select("id", F.col("rep").alias("class_id"), "n_links")


def exact_pairs(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All pairs (id1 < id2) of at least the threshold. Equal sets are compared once; their pairs come from the membership."""
    reps, member = classes(sets)
    return expanded(representative_pairs(reps, threshold), member)


def looked_up(rows: DataFrame, dictionary: DataFrame, key: str, frequency: DataFrame | None = None) -> DataFrame:
    """rows joined with a stored dictionary by key: by broadcast where that is small, else by shuffle, the rows of hot keys apart.

    frequency: key, df of the keys; those of at least HOT rows are few, whatever the table, and their entries are broadcast."""
    small = bounded(dictionary, tuple(c for c, kind in dictionary.dtypes if kind == "string"))
    if small is not dictionary or frequency is None:
        return rows.join(small, key)
    often = frequency.where(F.col("df") >= HOT).select(key)
    if often.isEmpty():
        return rows.join(dictionary, key)
    hot = stored(dictionary.join(F.broadcast(often), key, "left_semi"), "hot")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(dictionary, key))


def representative_pairs(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Stored pairs (id1 < id2) of at least the threshold, of different sets. sets: id, codes, as classes() stores them; they are deleted.

    Sets of n items in order of rarity: two sets that reach t share an item among their first items, fewer the nearer they are in
    size, so only these prefixes meet, and frequent items hardly ever. A pair's overlap is at most its matches in the prefixes
    and what the shorter rest after the last match has; pairs that this, their sizes or their bit maps rule out are not compared."""
    blocks, sizes = setblocks.packed(sets, setblocks.frequent(sets))
    remove(sets)
    found = stored(setblocks.compared(blocks, sizes, threshold), "pairs")
    remove(blocks)
    return found


def signatures(sets: DataFrame, hashes: int = BANDS * ROWS) -> DataFrame:
    """id, signature (array<long>): the smallest value of each hash over the set's token indexes (dense ranks of the tokens).

    A set's indexes are gathered once; the minima are then taken in place, a batch of sets at a time for each hash."""
    sets = stored(sets.select("id", F.array_distinct("items").alias("items")), "sets")
    each = sets.select("id", F.explode("items").alias("item"))
    frequency = stored(each.groupBy("item").agg(F.count(F.lit(1)).alias("df")), "frequency")
    ids = stored(dense_ids(frequency, "item", "idx"), "ids")
    gathered = looked_up(each, ids, "item", frequency).groupBy("id").agg(F.collect_list("idx").alias("x"))

    def kernel(batches):
        for batch in batches:
            lists = batch.column(1)
            begins = lists.offsets.to_numpy()
            # Below the modulus, products stay below 2**34.
            x = lists.flatten().to_numpy() % MODULUS
            out = np.empty((batch.num_rows, hashes), np.int64)
            for k in range(hashes if batch.num_rows else 0):
                a, b = coefficients(k)
                out[:, k] = np.minimum.reduceat((x * a + b) % MODULUS, begins[:-1] - begins[0])
            places = pa.array(np.arange(batch.num_rows + 1) * hashes, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(places, pa.array(out.ravel()))], names=["id", "signature"])

    return gathered.mapInArrow(kernel, f"id {dict(sets.dtypes)['id']}, signature array<long>")


def candidates(signed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id1 < id2 that agree in all rows of some band."""
    part = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.slice("signature", b * rows + 1, rows).alias("key")))
    if bands * MODULUS**rows < 1 << 63:  # a band and its rows are one number
        part = F.transform(part, lambda p: F.aggregate(p["key"], p["band"].cast("long"), lambda acc, x: acc * MODULUS + x))
    buckets = signed.select("id", F.explode(part).alias("b"))
    a = buckets.select(F.col("id").alias("id1"), "b")
    b = buckets.select(F.col("id").alias("id2"), "b")
    return a.join(b, "b").where(F.col("id1") < F.col("id2")).select("id1", "id2").distinct()


def _band_keys(blocks: DataFrame, sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """block, keys: bands numbers a set of packed blocks, in the order of its sets, that stand for a band and the rows of its signature.

    The indexes of a block's tokens are looked up once for each different token of the block."""
    names = dense_ids(sets.select(F.explode("items").alias("item")), "item", "idx").select(F.xxhash64("item").alias("code"), "idx")
    folder = blocks.stored_at

    def different(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                codes = np.unique(setblocks.load(folder, k).codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), k), pa.int32()), pa.array(codes)], names=["block", "code"])

    used = blocks.select("block").repartition(max(1, blocks.rdd.getNumPartitions())).mapInArrow(different, "block int, code long")

    def keys(table: pa.Table) -> pa.Table:
        k = table["block"][0].as_py()
        codes, idx = table["code"].to_numpy(), table["idx"].to_numpy()
        order = np.argsort(codes)
        block = setblocks.load(folder, k)
        # Below the modulus, products stay below 2**34.
        x = idx[order][np.searchsorted(codes[order], block.codes)] % MODULUS
        out = np.empty((len(block.n), bands), np.int64)
        for band in range(bands):
            out[:, band] = band
            for h in range(band * rows, band * rows + rows):
                a, b = coefficients(h)
                out[:, band] = out[:, band] * MODULUS + np.minimum.reduceat((x * a + b) % MODULUS, block.begins)
        flat = out.ravel()
        return pa.table({"block": pa.array([k], pa.int32()), "keys": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))})

    # The size of a kernel's rows is guessed from its input, which is one number a block here: without the hint they are broadcast.
    return stored(used.join(names.hint("merge"), "code").groupBy("block").applyInArrow(keys, "block int, keys array<long>"), "bands", "block")


def similar_by_minhash(sets: DataFrame, threshold: float = 0.5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Candidates that exact comparison confirms: no false pair; a pair of similarity s is found with probability recall(s).

    A band and its rows are one number (beyond 63 bits: modulo 2**64). Candidates are made where two blocks of sets meet, and
    those that sizes and bit maps rule out are not compared."""
    reps, member = classes(sets)
    blocks, sizes = setblocks.packed(reps)
    remove(reps)
    banded = _band_keys(blocks, sets, bands, rows)
    folder = banded.stored_at

    def keyed(block: int) -> np.ndarray:
        return setblocks.read(folder, block)["keys"].combine_chunks().flatten().to_numpy()

    found = stored(setblocks.compared(blocks, sizes, threshold, keyed), "pairs")
    remove(blocks)
    remove(banded)
    return expanded(found, member)


def recall(s: float, bands: int = BANDS, rows: int = ROWS) -> float:
    return 1 - math.pow(1 - s**rows, bands)
