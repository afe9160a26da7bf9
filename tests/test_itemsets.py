from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodeworks.operators import itemsets
from lodeworks.sources import sinks


def frame(spark, baskets):
    return spark.createDataFrame([(i, sorted(b)) for i, b in enumerate(baskets)], "basket long, items array<string>")


def brute(baskets, support):
    found = {}
    for b in baskets:
        for k in range(1, len(b) + 1):
            for c in combinations(sorted(b), k):
                found[c] = found.get(c, 0) + 1
    return {c: n for c, n in found.items() if n >= support}


def rows(df):
    return {tuple(r["items"]): r.freq for r in df.collect()}


BASKETS = [{"a", "b", "c"}, {"a", "b"}, {"a", "c"}, {"b", "c"}, {"a", "b", "c"}]


def test_known_itemsets(spark):
    assert rows(itemsets.frequent_itemsets(frame(spark, BASKETS), 3)) == brute(BASKETS, 3)
    assert len(brute(BASKETS, 3)) == 6


def test_empty_and_rare(spark):
    empty = spark.createDataFrame([], "basket long, items array<string>")
    assert rows(itemsets.frequent_itemsets(empty, 1)) == {}
    assert rows(itemsets.frequent_itemsets(frame(spark, BASKETS), 6)) == {}
    assert itemsets.local_frequent(empty, 4, 2).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.sampled_from("abcdef"), min_size=1), min_size=1, max_size=12), st.integers(1, 4))
def test_two_passes_are_exact(spark, baskets, support):
    found = frame(spark, baskets)
    expected = brute(baskets, support)
    assert rows(itemsets.frequent_itemsets(found, support)) == expected
    assert rows(itemsets.fp_growth(found, support)) == expected
    candidates = itemsets.local_frequent(found, support, 2)
    assert set(expected) <= {tuple(r["items"]) for r in candidates.collect()}
    assert rows(itemsets.count_candidates(found, candidates, support)) == expected


def test_basket_filter_counts_repeats(spark):
    df = spark.createDataFrame([("u1", "x"), ("u1", "x"), ("u1", "y"), ("u2", "x"), ("u2", "y")], "u string, i string")
    kept = itemsets.baskets(df, "u", "i", more_than=2).collect()
    assert [(r.basket, r["items"]) for r in kept] == [("u1", ["x", "y"])]


def test_report(spark, tmp_path):
    found = itemsets.frequent_itemsets(frame(spark, BASKETS), 3)
    sinks.write_itemset_report([sinks.itemset_report(found, "Frequent Itemsets")], str(tmp_path / "r"))
    assert (tmp_path / "r").read_text() == "Frequent Itemsets:\n('a'),('b'),('c')\n\n('a', 'b'),('a', 'c'),('b', 'c')\n\n"


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_partitions_do_not_matter(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows(itemsets.frequent_itemsets(frame(spark, BASKETS), 3)) == brute(BASKETS, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trees_hold_items_of_frequent_pairs_alone(spark, monkeypatch):
    """Many frequent items, one frequent triple: the trees are grown from its three items; without a frequent pair there is no tree."""
    grown = []

    class Seen(itemsets.FPGrowth):
        def fit(self, found):
            grown.append({i for r in found.collect() for i in r["items"]})
            return super().fit(found)

    monkeypatch.setattr(itemsets, "FPGrowth", Seen)
    baskets = [{f"i{n % 7}", f"j{n % 11}", *({"x", "y", "z"} if n % 5 == 0 else set())} for n in range(100)]
    assert rows(itemsets.fp_growth(frame(spark, baskets), 9)) == brute(baskets, 9)
    assert grown == [{"x", "y", "z"}]
    baskets = [{f"i{n % 7}", f"j{n % 11}"} for n in range(77)]
    assert rows(itemsets.fp_growth(frame(spark, baskets), 5)) == brute(baskets, 5)
    assert len(brute(baskets, 5)) == 18 and len(grown) == 1
    assert rows(itemsets.fp_growth(frame(spark, baskets), 500)) == {}
