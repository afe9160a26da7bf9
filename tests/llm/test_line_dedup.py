import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import line_dedup
from lodeworks.llm.common import new_path
from lodeworks.llm.oracles import OP9
from tests.compare import connect, difference
from tests.llm.fixtures import CLASHING, SF, documents, empty, key_rows, odd_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plain(rows, min_docs, min_chars=1):
    """(doc_id, lines, dropped, kept text) of each row."""
    found = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if len(k) >= min_chars)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or not key(x) or found[key(x)] < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (2, 1), (3, 9)])
def test_equals_plain(spark, min_docs, min_chars):
    rows = odd_documents()
    expected = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(rows, min_docs, min_chars)]
    found = line_dedup.dedup_report(documents(spark), min_docs, min_chars).collect()
    assert key_rows(found) == key_rows(expected)
    assert sum(x[2] for x in expected) > 5


def test_equals_sql(spark):
    duck = connect(SF)
    assert difference(line_dedup.dedup_report(spark.read.parquet(f"{SF}/documents.parquet")), duck.sql(OP9)) == ""


def test_all_columns_are_kept(spark):
    docs = documents(spark, clashing=True)
    out = line_dedup.drop_common_lines(docs, 10)
    assert out.columns == docs.columns
    expected = key_rows((i, t, len(t)) for i, _, _, t in plain(odd_documents(), 10))
    assert key_rows(out.select("doc_id", "text", "n_chars").collect()) == expected
    for r in out.collect():
        assert r["row"] == f"row-{'none' if r.doc_id is None else r.doc_id}" and set(CLASHING) <= set(r.asDict())


def test_empty_table(spark):
    assert line_dedup.dedup_report(empty(spark)).count() == 0
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0


def test_levels(spark):
    """Runs stay sorted, levels stay below the fan-in, and counts add up over batches."""
    runs = line_dedup.LineRuns(spark, min_docs=3, fan_in=2)
    batches = [["a", "b"], ["a", "c"], ["a", "b"], ["a", "d"], ["b", "d"]]
    for batch in batches:
        runs.add(spark.createDataFrame([(x, 1) for x in batch], "k string, n long").select(*line_dedup.hashed(F.col("k")), "n"))
        assert all(len(level) < 2 for level in runs.levels)
        for run in (run for level in runs.levels for run in level):
            by_bucket = runs.frame(run).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "h1", "h2").orderBy("i").collect()
            assert by_bucket == sorted(by_bucket, key=lambda r: (r.p, r.h1, r.h2))
    keys = spark.createDataFrame([(x,) for x in "abcd"], "k string").select("k", *line_dedup.hashed(F.col("k")))
    assert {r.k for r in keys.join(runs.common(), ["h1", "h2"]).collect()} == {"a", "b"}


def hashes(spark, numbers):
    return spark.createDataFrame([(f"line {i}", 1) for i in numbers], "k string, n long").select(*line_dedup.hashed(F.col("k")), "n")


def test_runs_are_merged_and_never_shuffled(spark):
    """Plans: the batch is exchanged and sorted once; runs are neither."""
    runs = line_dedup.LineRuns(spark, min_docs=1, fan_in=5, buckets=6)
    for a in (0, 2000, 4000):
        runs.add(hashes(spark, range(a, a + 3000)))
    spark.conf.set(line_dedup.ORDERED, "true")
    try:
        new = runs.unseen(hashes(spark, range(5000, 9000)))
        plan = new._jdf.queryExecution().executedPlan().toString()
        merged = runs._merged(runs.levels[0][:2])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(line_dedup.ORDERED)
    assert plan.count("SortMergeJoin") == 3 == plan.count("LeftAnti") and "Broadcast" not in plan
    assert plan.count("Exchange") == 1 and len(re.findall(r"\bSort \[", plan)) == 1 and plan.count("Bucketed: true") == 3
    assert "Exchange" not in merged and "SortMergeJoin" in merged and not re.findall(r"\bSort \[", merged)
    assert new.count() == 2000


def runs_of(spark, path):
    fs, folder, _ = line_dedup.LineRuns(spark, 3, path=path)._files()
    return {f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("run-")}


def kept_runs(spark, path):
    return {run for level in line_dedup.LineRuns(spark, 3, path=path).levels for run in level}


@pytest.mark.parametrize("join", [False, True])
def test_two_calls_over_a_path_equal_one(spark, monkeypatch, join):
    if join:
        monkeypatch.setattr(line_dedup, "IN_PLACE", 0)
    rows, path = odd_documents(), new_path(spark, "test-runs")
    line_dedup.dedup_report(documents(spark, rows=rows[::2]), 3, 9, path).count()
    found = line_dedup.dedup_report(documents(spark, rows=rows[1::2]), 3, 9, path).collect()
    both = plain(rows, 3, 9)[1::2]
    assert key_rows(found) == key_rows((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in both)
    assert both != plain(rows[1::2], 3, 9)
    assert runs_of(spark, path) == kept_runs(spark, path) and kept_runs(spark, path)


def test_a_stopped_call_counts_nothing(spark, monkeypatch):
    rows, path = odd_documents(), new_path(spark, "test-runs")
    line_dedup.common_keys(documents(spark, rows=rows[:30]), 3, 1, path=path)

    def stops(self):
        raise RuntimeError("stopped")

    monkeypatch.setattr(line_dedup.LineRuns, "common", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        line_dedup.common_keys(documents(spark, rows=rows[30:]), 3, 1, path=path)
    monkeypatch.undo()
    assert runs_of(spark, path) == kept_runs(spark, path)
    again = line_dedup.common_keys(documents(spark, rows=rows[30:]), 3, 1, path=path)
    assert key_rows(again.collect()) == key_rows(line_dedup.common_keys(documents(spark, rows=rows), 3, 1).collect())


@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (3, 9)])
def test_join_equals_plain(spark, monkeypatch, min_docs, min_chars):
    monkeypatch.setattr(line_dedup, "IN_PLACE", 0)
    test_equals_plain(spark, min_docs, min_chars)
    test_all_columns_are_kept(spark)


def test_texts_are_not_shuffled_where_common_keys_are_few(spark):
    out = line_dedup.drop_common_lines(spark.read.parquet(f"{SF}/documents.parquet"), 10)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_native(spark):
    plan = line_dedup.dedup_report(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
