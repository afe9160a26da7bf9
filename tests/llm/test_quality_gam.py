import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import quality_gam
from tests.llm.fixtures import documents, empty, odd_documents

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_gam.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in rows if r.quality == 1], [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_folds_and_odd_rows(spark):
    rows = odd_documents()
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (61, None, 0), (1, 0, 0), (1, 1, 0)], LABELS)
    found = quality_gam.score(documents(spark, clashing=True), labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_held_out_labels_teach_nothing(spark):
    docs = documents(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], LABELS)
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality_gam.score(docs, labels).collect()), key=repr) == sorted(map(tuple, quality_gam.score(docs, other).collect()), key=repr)


@pytest.mark.parametrize(("labels", "expected"), [([], 0.5), ([(1, 1, 0), (2, 1, 0), (3, 1, 0)], None)])
def test_without_two_classes(spark, labels, expected):
    scores = {r.score for r in quality_gam.score(documents(spark), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(scores) == 1 and (expected is None or scores == {expected})


def test_pairs_learn_an_interaction():
    """An exclusive or has no main effects."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (4000, len(quality_gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality_gam.Gam().fit(x[:3000], y[:3000])
    assert (model.pair_tables[0][0], model.pair_tables[0][1]) == (2, 5)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, len(quality_gam.FEATURES)))
    model = quality_gam.Gam(rounds=5, pair_rounds=3).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, score in zip(x[:40], model.score(x[:40])):
        raw = model.intercept
        for f, (edges, table) in enumerate(zip(model.edges, model.tables)):
            raw += table[sum(row[f] >= e for e in edges)]
        for a, b, table in model.pair_tables:
            raw += table[sum(row[a] >= e for e in model.coarse[a]), sum(row[b] >= e for e in model.coarse[b])]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert quality_gam.score(empty(spark), labels).count() == 0
