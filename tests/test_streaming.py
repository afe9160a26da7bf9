import json

from lodeworks.operators import profile
from lodeworks.sources import readers
from lodeworks.streaming import profile as streaming


def test_stream_equals_batch(spark, tmp_path):
    for k in range(4):
        rows = [{"user_id": f"u{(i * k) % 5}", "business_id": f"b{i % 3}", "stars": 1.0, "date": f"2018-01-{k + 1:02d}"} for i in range(20)]
        (tmp_path / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = streaming.review_stream(spark, str(tmp_path), files_a_batch=1)
    query = streaming.key_counts(stream, "user_id").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    batch = profile.top_keys(readers.reviews(spark, str(tmp_path)), "user_id", 100)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_closed_windows_are_emitted_once(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.json").write_text(json.dumps({"user_id": "u", "business_id": "b", "stars": 1.0, "date": f"2018-01-{k + 1:02d}"}) + "\n")
    stream = streaming.review_stream(spark, str(tmp_path))
    counts = streaming.windowed_counts(stream, "user_id", "date", "1 day", "1 day")
    query = counts.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("windows").collect()
    assert rows and all(r.n == 1 for r in rows) and len({r.start for r in rows}) == len(rows)
