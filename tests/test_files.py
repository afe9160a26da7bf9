"""Readers, sinks and the command line on files in the workloads' formats."""

import json
import random

import pytest

from lodeworks import cli
from lodeworks.operators import layout
from lodeworks.sources import readers


def parts(path):
    return [line for p in sorted(path.glob("part-*")) for line in p.read_text().splitlines()]


@pytest.fixture
def reviews(tmp_path):
    rows = [("u1", "b1", 5.0, "2018-01-02"), ("u2", "b1", 3.0, "2017-05-05"), ("u1", "b2", 4.0, "2018-03-03"), ("u3", "b9", 1.0, "2016-01-01")]
    path = tmp_path / "reviews.json"
    path.write_text("".join(json.dumps(dict(zip(("user_id", "business_id", "stars", "date"), r))) + "\n" for r in rows))
    return path


@pytest.fixture
def businesses(tmp_path):
    rows = [("b1", "X", 4.0, 10), ("b2", "A", 3.5, 20), ("b3", "Z", 1.0, 5)]
    path = tmp_path / "business.json"
    path.write_text("".join(json.dumps(dict(zip(("business_id", "city", "stars", "review_count"), r))) + "\n" for r in rows))
    return path


def test_profile(spark, reviews, tmp_path):
    cli.main(["profile", str(reviews), str(tmp_path / "out")], spark)
    found = json.loads((tmp_path / "out").read_text())
    assert found["n_review"] == 4 and found["n_review_year"] == 2 and found["n_user"] == 3 and found["n_business"] == 3
    assert found["top10_user"] == [["u1", 2], ["u2", 1], ["u3", 1]]
    assert found["top10_business"][0] == ["b1", 2]


def test_layout(spark, reviews, tmp_path):
    cli.main(["layout", str(reviews), str(tmp_path / "out"), "3"], spark)
    found = json.loads((tmp_path / "out").read_text())
    assert found["customized"]["n_partition"] == 3 and len(found["customized"]["n_items"]) == 3
    assert sum(found["customized"]["n_items"]) == sum(found["default"]["n_items"]) == 4
    assert found["default"]["exe_time"] > 0


def test_averages(spark, reviews, businesses, tmp_path):
    cli.main(["averages", str(reviews), str(businesses), str(tmp_path / "out"), str(tmp_path / "timing")], spark)
    assert parts(tmp_path / "out") == ["A,4.0", "X,4.0"]
    assert set(json.loads((tmp_path / "timing").read_text())) == {"m1", "m2", "explanation"}


def test_missing_and_malformed_fields_fail(spark, tmp_path):
    (tmp_path / "a").write_text('{"user_id": "u"}\n')
    with pytest.raises(Exception, match="has no business_id"):
        readers.reviews(spark, str(tmp_path / "a"), ("business_id",)).collect()
    (tmp_path / "b").write_text("{nonsense\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.reviews(spark, str(tmp_path / "b")).collect()


def test_headers(spark, tmp_path):
    (tmp_path / "p").write_text("user_id,business_id\nu,b\nuser_id,business_id\nv,\"c\n")
    assert [tuple(r) for r in readers.pairs(spark, str(tmp_path / "p")).collect()] == [("u", "b"), ("v", '"c')]
    assert [tuple(r) for r in readers.pairs(spark, str(tmp_path / "p"), header=None).collect()] == [("u", "b"), ("v", '"c')]
    (tmp_path / "r").write_text("user_id, business_id, stars\nu,b,4.5\nv,c\n")
    assert [tuple(r) for r in readers.ratings(spark, str(tmp_path / "r")).collect()] == [("u", "b", 4.5), ("v", "c", None)]


def test_points(spark, tmp_path):
    (tmp_path / "p").write_text("7,-1,0.5,2\n8,3,1,2\n")
    assert [tuple(r) for r in readers.points(spark, str(tmp_path / "p")).collect()] == [(7, -1, [0.5, 2.0]), (8, 3, [1.0, 2.0])]


def test_partitions(spark):
    assert layout.at_most(spark.range(10).repartition(6), 4).rdd.getNumPartitions() == 4
    assert layout.by_key(spark.range(10), 3, "id").rdd.getNumPartitions() == 3
    assert readers.with_min_partitions(spark.range(10).coalesce(1), 5).rdd.getNumPartitions() == 5


def test_itemsets(spark, tmp_path):
    baskets = {"u1": "abc", "u2": "ab", "u3": "ac", "u4": "bc", "u5": "abc"}
    (tmp_path / "p").write_text("user_id,business_id\n" + "".join(f"{u},{i}\n" for u, items in baskets.items() for i in items))
    for case, command in enumerate((["itemsets", "1", "3"], ["large-baskets", "1", "3"])):
        cli.main([*command, str(tmp_path / "p"), str(tmp_path / f"out{case}")], spark)
        text = (tmp_path / f"out{case}").read_text()
        assert text.startswith("Candidates:\n") and text.endswith("Frequent Itemsets:\n('a'),('b'),('c')\n\n('a', 'b'),('a', 'c'),('b', 'c')\n\n")
    cli.main(["itemsets", "2", "5", str(tmp_path / "p"), str(tmp_path / "out2")], spark)
    assert (tmp_path / "out2").read_text().endswith("Frequent Itemsets:\n")or "Frequent Itemsets" not in (tmp_path / "out2").read_text()


def test_similar(spark, tmp_path):
    rows = [(u, b) for b, users in {"x": "123", "y": "234", "z": "9"}.items() for u in users]
    (tmp_path / "r").write_text("user_id, business_id, stars\n" + "".join(f"{u},{b},1\n" for u, b in rows))
    cli.main(["similar", str(tmp_path / "r"), str(tmp_path / "out")], spark)
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_bytes().decode().split("\r\n") if line]
    assert lines[0] == "business_id_1, business_id_2, similarity"
    assert lines[1:] == ["x,y,0.5"]


@pytest.mark.parametrize("case", [1, 2, 3, 4])
def test_recommend(spark, businesses, tmp_path, case):
    (tmp_path / "train").write_text("user_id, business_id, stars\nu1,b1,5\nu1,b2,3\nu2,b1,4\nu2,b2,2\nu2,b3,5\nu3,b1,2\nu3,b2,1\n")
    (tmp_path / "test").write_text("user_id, business_id, stars\nu1,b3,4\nnew,b1,2\n")
    out = tmp_path / "out"
    cli.main(["recommend", str(tmp_path / "train"), str(businesses), str(tmp_path / "test"), str(case), str(out)], spark)
    text = "".join(p.read_bytes().decode() for p in sorted(out.glob("part-*")))
    assert text.startswith("user_id, business_id, prediction\r\n") and "u1,b3," in text
    assert ("new,b1," in text) == (case != 1)


def test_graph_commands(spark, tmp_path):
    rng = random.Random(1)
    rows = [(u, f"i{g}-{k}") for g, users in enumerate(("abc", "def")) for u in users for k in range(8)] + [("c", f"j{k}") for k in range(7)] + [("d", f"j{k}") for k in range(7)]
    rng.shuffle(rows)
    (tmp_path / "p").write_text("user_id,business_id\n" + "".join(f"{u},{i}\n" for u, i in rows))
    cli.main(["betweenness", str(tmp_path / "p"), str(tmp_path / "edges")], spark)
    lines = parts(tmp_path / "edges")
    assert lines[0] == "('c', 'd'), 9.0" and len(lines) == 7
    cli.main(["communities", str(tmp_path / "p"), str(tmp_path / "groups")], spark)
    assert parts(tmp_path / "groups") == ["'a', 'b', 'c'", "'d', 'e', 'f'"]


def test_clusters(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "p").write_text("".join(f"{i},{i % 2},{rng.gauss(30 * (i % 2), 1)},{rng.gauss(0, 1)}\n" for i in range(800)))
    cli.main(["clusters", str(tmp_path / "p"), "2", str(tmp_path / "out")], spark)
    rounds, labels = parts(tmp_path / "out" / "rounds"), parts(tmp_path / "out" / "labels")
    assert len(rounds) == 5 and rounds[0].startswith("Round 1: ")
    assert [int(x.split(",")[0]) for x in labels] == list(range(800))
