import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks import storage
from lodeworks.functions.hashing import MODULUS, coefficients, dense_ids
from lodeworks.operators import setblocks, similarity


def sets_frame(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, items array<string>")


def brute(sets, t):
    return {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) / len(a | b) >= t}


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(3)
    base = [{f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))} for _ in range(40)]
    near = [set(s) ^ {f"t{rng.randrange(60)}"} or {"t0"} for s in base]
    return base + near + [{"a", "b", "c"}, {"b", "c", "d"}]


def got(df):
    return {(r.id1, r.id2): r.similarity for r in df.collect()}


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_exact_pairs(spark, sets, t):
    assert got(similarity.exact_pairs(sets_frame(spark, sets), t)) == pytest.approx(brute(sets, t))


def test_copies_are_counted_not_expanded(spark, sets):
    many = sets + [sets[0]] * 25 + [sets[5]] * 3
    expected = {i: 0 for i in range(len(many))}
    for i, j in brute(many, 0.5):
        expected[i] += 1
        expected[j] += 1
    rows = similarity.link_counts(sets_frame(spark, many), 0.5).collect()
    assert {r.id: r.n_links for r in rows} == expected
    assert {r.id: r.class_id for r in rows} == {i: many.index(s) for i, s in enumerate(many)}


def test_half_is_included(spark):
    assert got(similarity.exact_pairs(sets_frame(spark, [{"1", "2", "3"}, {"2", "3", "4"}]))) == {(0, 1): 0.5}


def test_minhash_finds_only_true_pairs_and_nearly_all(spark, sets):
    found, expected = got(similarity.similar_by_minhash(sets_frame(spark, sets))), brute(sets, 0.5)
    assert set(found) <= set(expected)
    assert len(found) >= 0.97 * len(expected)


def test_recall():
    assert [round(similarity.recall(s), 4) for s in (0.5, 0.3, 0.1)] == [0.9987, 0.7455, 0.0488]


def test_no_hash_is_constant():
    pairs = [coefficients(k) for k in range(150)]
    assert all(a % MODULUS for a, _ in pairs) and len(set(pairs)) == 150


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in ["c", "a", "b", "a", None]], "k string")
    assert {r.k: r.i for r in dense_ids(df, "k", "i").collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_token_in_every_set(spark, monkeypatch, broadcast):
    """Over many partitions, by broadcast dictionaries or with the hot tokens apart: as plain, and no task has all rows of the token."""
    rng = random.Random(8)
    many = [{"everywhere", *(f"t{rng.randrange(30)}" for _ in range(rng.randrange(1, 6)))} for _ in range(120)]
    if not broadcast:
        monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(similarity, "HOT", 60)
    df = sets_frame(spark, many).repartition(7)
    assert got(similarity.exact_pairs(df, 0.7)) == pytest.approx(brute(many, 0.7))
    names = {t: i for i, t in enumerate(sorted(set().union(*many)))}
    expected = {i: [min((names[t] * a + b) % MODULUS for t in s) for a, b in map(coefficients, range(150))] for i, s in enumerate(many)}
    assert {r.id: r.signature for r in similarity.signatures(df).collect()} == expected
    spread = similarity.looked_up(df.select("id", F.explode("items").alias("item")), similarity.stored(spark.createDataFrame(names.items(), "item string, i long"), "names"),
                                  "item", spark.createDataFrame([(t, sum(t in s for s in many)) for t in names], "item string, df long"))
    places = spread.where("item = 'everywhere'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in places) == 120 and len(places) >= 7


def test_nulls_and_repeats_within_a_set(spark):
    rows = [(1, ["a", "b", None]), (2, ["b", "a", "a"]), (3, [None]), (4, []), (5, None), (6, ["c"])]
    df = spark.createDataFrame(rows, "id long, items array<string>")
    assert got(similarity.exact_pairs(df)) == {(1, 2): 1.0} == got(similarity.similar_by_minhash(df))
    assert {r.id: (r.class_id, r.n_links) for r in similarity.link_counts(df).collect()} == {1: (1, 1), 2: (1, 1), 6: (6, 0)}
    texts = spark.createDataFrame([(1, "A  b a"), (2, " "), (3, ""), (4, None)], "k long, t string")
    assert [tuple(r) for r in similarity.token_sets(texts, "k", "t").collect()] == [(1, ["a", "b"])]


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, items array<string>")
    assert similarity.exact_pairs(empty).count() == 0
    assert similarity.similar_by_minhash(empty).count() == 0


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    nothing = gateway.jvm.java.util.ArrayList()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("find, tokens", [("exact_pairs", 60), ("link_counts", 60), ("similar_by_minhash", 36)])
def test_candidates_are_not_shuffled(spark, find, tokens):
    """600 sets of 12 tokens: most of the 180,000 pairs share rare enough tokens, or many a band, and hardly any are similar."""
    rng = random.Random(4)
    df = sets_frame(spark, [{f"t{x}" for x in rng.sample(range(tokens), 12)} for _ in range(600)])
    before = shuffled(spark)
    assert getattr(similarity, find)(df).count() < 2000
    assert shuffled(spark) - before < 30_000


def test_blocks(spark, sets, monkeypatch):
    """Many small blocks, and sizes of more sets than a block holds: the same pairs."""
    monkeypatch.setattr(setblocks, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(setblocks, "BLOCK_SETS", 5)
    monkeypatch.setattr(setblocks, "RUN", 3)
    reps, _ = similarity.classes(sets_frame(spark, sets))
    blocks, sizes = setblocks.packed(reps, setblocks.frequent(reps))
    assert len(sizes) > 10
    kept = {r.id for r in reps.collect()}
    assert got(setblocks.compared(blocks, sizes, 0.3)) == pytest.approx({p: s for p, s in brute(sets, 0.3).items() if set(p) <= kept})


@pytest.mark.parametrize("t", [0.2, 0.5, 0.8])
@pytest.mark.parametrize("matches", [50, 4_000_000])
def test_matches_in_slices(monkeypatch, t, matches):
    monkeypatch.setattr(setblocks, "MATCHES", matches)
    rng = random.Random(1)
    many = sorted({tuple(sorted(rng.sample(range(80), rng.randrange(1, 30)))) for _ in range(300)}, key=len)

    def block(part):
        return setblocks.Block(pa.array(range(len(part))), np.array([len(s) for s in part]), np.array([c for s in part for c in s], np.int64))

    one, two = many[:150], many[120:]
    for a, b, same in ((one, two, False), (one, one, True)):
        left = block(a)
        found = {(i, j): s for x in setblocks.similar(left, left if same else block(b), t, same) for i, j, s in zip(*(y.tolist() for y in x))}
        each = {(i, j): len({*x} & {*y}) / len({*x, *y}) for i, x in enumerate(a) for j, y in enumerate(b) if not same or i < j}
        assert found == {p: s for p, s in each.items() if s >= t}
