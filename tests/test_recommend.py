import math
import random

import pytest

from lodeworks.functions import pairing
from lodeworks.operators import recommend

TRAIN = [("u1", "b1", 5.0), ("u1", "b2", 3.0), ("u2", "b1", 4.0), ("u2", "b2", 2.0), ("u2", "b3", 5.0), ("u3", "b1", 2.0), ("u3", "b3", 1.0)]
FEATURES = "item string, stars double, norm_stars double, norm_count double"


def frames(spark, targets, features=()):
    return (
        spark.createDataFrame(TRAIN, "user string, item string, stars double"),
        spark.createDataFrame(list(features), FEATURES),
        spark.createDataFrame(targets, "user string, item string"),
    )


def got(df):
    return {(r.user, r.item): (r.branch, r.prediction) for r in df.collect()}


def test_user_based(spark):
    found = got(recommend.predict_user_based(*frames(spark, [("u1", "b3"), ("x", "b1"), ("u1", "z"), ("x", "z"), ("u1", "b1")])))
    assert found["u1", "b3"] == ("cf", pytest.approx(4.392857142857143))
    assert found["x", "b1"] == ("new_user", 3.0)
    assert found["u1", "z"] == ("new_item", 4.0)
    assert found["x", "z"] == ("new_user", 3.0)
    assert found["u1", "b1"] == ("known", 5.0)


def test_item_based(spark):
    found = got(recommend.predict_item_based(*frames(spark, [("u1", "b3"), ("x", "b1"), ("u1", "z"), ("x", "z")])))
    assert found["u1", "b3"] == ("cf", pytest.approx(3.9515019931747384))
    assert found["x", "b1"] == ("new_user", pytest.approx(11 / 3))
    assert found["u1", "z"] == ("new_item", 3.0)
    assert found["x", "z"] == ("new_item", 3.0)


def test_hybrid(spark):
    found = got(recommend.predict_hybrid(*frames(spark, [("u1", "z"), ("u1", "w"), ("x", "w")], [("w", 4.5, 0.9, 0.5), ("b1", 4.0, 0.8, 0.5)])))
    assert found["u1", "z"] == ("new_item", 3.5)
    assert found["x", "w"] == ("new_user", 4.5)
    # b1 is the only rated item with content: 4.5 + (5 - 4) held at 5.
    assert found["u1", "w"] == ("cf", 5.0)


def test_features_serve_new_users(spark):
    found = got(recommend.predict_user_based(*frames(spark, [("x", "b1")], [("b1", 4.5, 0.9, 0.1)])))
    assert found["x", "b1"] == ("new_user", 4.5)


def test_cosine_and_pearson(spark):
    train, _, _ = frames(spark, [("u1", "b1")])
    pairs = spark.createDataFrame([("u1", "u2"), ("u1", "u3")], "a string, b string")
    cosine = {(r.a, r.b): r.w for r in recommend.cosine(train, pairs, "user", "item").collect()}
    assert cosine["u1", "u2"] == pytest.approx(26 / math.sqrt(34 * 45))
    pearson = {(r.a, r.b): r.w for r in recommend.pearson(train, pairs, "user", "item").collect()}
    assert pearson == {("u1", "u2"): pytest.approx(1.0), ("u1", "u3"): 0.0}


def test_rmse(spark):
    actual = spark.createDataFrame([("a", "x", 3.0), ("b", "x", 5.0), ("c", "x", 1.0)], "user string, item string, stars double")
    predicted = spark.createDataFrame([("a", "x", 4.0), ("b", "x", 3.0)], "user string, item string, prediction double")
    assert recommend.rmse(actual, predicted).first().rmse == pytest.approx(math.sqrt(2.5))


def test_als_is_repeatable_and_drops_unknown(spark):
    train, _, targets = frames(spark, [("u1", "b3"), ("x", "b1")])
    a, b = (got_rows(recommend.predict_als(train, targets)) for _ in range(2))
    assert a == b and set(a) == {("u1", "b3")}


def got_rows(df):
    return {(r.user, r.item): r.prediction for r in df.collect()}


def test_dedupe_takes_one_rating(spark):
    rows = spark.createDataFrame([("a", "x", 3.0), ("a", "x", 4.0)], "user string, item string, stars double")
    assert [r.stars for r in recommend.dedupe(rows).collect()] == [4.0]


@pytest.mark.parametrize("names", [False, True])
@pytest.mark.parametrize("tile", [4, 5000])
def test_all_pairs_cosine_shuffles_no_pairs(spark, monkeypatch, tile, names):
    """Many blocks, long entities in several lists, keys far apart or no numbers: as plain; and pairs are added up where they are made."""
    monkeypatch.setattr(pairing, "TILE", tile)
    monkeypatch.setattr(pairing, "BLOCK_PAIRS", 30)
    rng = random.Random(5)
    made = {(f"u{rng.randrange(12)}", f"i{i}" if names else i**3): float(rng.randrange(1, 6)) for i in range(40) for _ in range(4)}
    rows = [(u, i, s) for (u, i), s in made.items()]
    train = spark.createDataFrame([*rows, (None, rows[0][1], 2.0), ("u1", None, 2.0)], f"user string, item {'string' if names else 'long'}, stars double")
    kept = {(u, i): s for u, i, s in rows}
    norm = {}
    for u, i, s in [*rows, (None, rows[0][1], 2.0)]:
        norm[i] = norm.get(i, 0) + s * s
    expected = {}
    for (u, a), x in kept.items():
        for (v, b), y in kept.items():
            if u == v and a < b:
                expected[a, b] = expected.get((a, b), 0) + x * y
    found = recommend.cosine(train, None, "item", "user")
    got = {(r.a, r.b): r.w for r in found.collect()}
    assert got == pytest.approx({(a, b): dot / math.sqrt(norm[a] * norm[b]) for (a, b), dot in expected.items()})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(arrays_zip(right")]
