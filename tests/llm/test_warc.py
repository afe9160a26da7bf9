import base64
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import warc
from lodeworks.llm.common import new_path
from lodeworks.llm.oracles import OP6
from tests.compare import connect, difference
from tests.llm.fixtures import SF, key_rows

SCHEMA = "page_id long, url string, html string"


def odd_pages():
    html = ["<p>a</p>", "<p>ü 日</p>", "", None, "a\r\n\r\nWARC/1.1\r\n\r\nb", "x" * 200_000]
    rows = [(i, f"http://www.Site{i % 4}.example.com:80/p/{i % 7}?q=A#f", html[i % len(html)]) for i in range(60)]
    rows += [(59, "http://a/", html[5]), (59, "http://a/", html[5]), (None, "http://b/", html[0]), (None, None, "only nulls"), (None, None, "only nulls")]
    rows += [(70, None, "no url"), (71, "", "empty url"), (72, "http://[bad", "bad url"), (73, "two\r\nlines: x", "odd url"), (74, "http://ü.example/ß", "letters"), (-5, "http://c/", "negative")]
    return rows


def plain(rows, min_bytes):
    groups = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= min_bytes:
            groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((x for x in groups.get(h or "", []) if x is not None), default=None)
        again = top is not None and i != top
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    return out


@pytest.mark.parametrize("min_bytes", [0, 20])
def test_equals_plain(spark, min_bytes):
    pages = spark.createDataFrame(odd_pages(), SCHEMA).repartition(5)
    assert key_rows(warc.report(pages, min_bytes).collect()) == key_rows(plain(odd_pages(), min_bytes))


def test_equals_sql(spark):
    assert difference(warc.report(spark.read.parquet(f"{SF}/pages.parquet")), connect(SF).sql(OP6)) == ""


def test_index_is_in_order_and_points_to_records(spark):
    pages = spark.createDataFrame(odd_pages(), SCHEMA).repartition(5)
    folder = new_path(spark, "test-warc")
    rows = sorted(warc.capture_index(pages, folder=folder).collect(), key=lambda r: (r.part, r.seq))
    keys = [(r.urlkey, r.ts, -(1 << 63) if r.page_id is None else r.page_id) for r in rows]
    assert keys == sorted(keys) and len({r.file for r in rows}) > 1
    store, root = warc.opened(folder)
    for r in rows[::7]:
        with store.open_input_file(f"{root}/{r.file}") as f:
            f.seek(r.offset)
            (_, _, raw), = warc.members(f_slice(f.read(r.length)))
        assert warc.parsed(raw)["page_id"] == r.page_id and warc.parsed(raw)["url"] == (r.url)


@pytest.mark.parametrize("fan_in", [2, 3])
def test_more_runs_than_the_fan_in(spark, fan_in):
    """Several passes over runs of few rows: the same rows, in global order, by ranges."""
    pages = spark.createDataFrame(odd_pages() * 3, SCHEMA).repartition(5)
    rows = sorted(warc.capture_index(pages, fan_in=fan_in, run_rows=7, block_rows=3, range_rows=40, max_bytes=2000).collect(), key=lambda r: (r.part, r.seq))
    keys = [warc.key_of(tuple(r)) for r in rows]
    assert keys == sorted(keys) and len({r.part for r in rows}) > 3 and len({r.file for r in rows}) > 5
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert key_rows(found) == key_rows(plain(odd_pages() * 3, 0))


def test_a_merge_holds_one_block_a_run(tmp_path):
    rng = random.Random(4)
    store, root = warc.opened(str(tmp_path))
    blocks, rows = {}, []
    for run in range(9):
        mine = sorted(((f"k{rng.randrange(20)}", "t", rng.randrange(50), None, "d", 0, "response", None, f"f{run}", i, 1) for i in range(rng.randrange(1, 90))), key=warc.key_of)
        out = warc.SegmentWriter(store, root, str(run), 0, 5)
        for row in mine:
            out.add(row)
        index = out.close()
        assert [b["n"] for b in index] == [min(5, len(mine) - 5 * i) for i in range(len(index))]
        blocks[str(run)] = [(b["file"], b["block"]) for b in index]
        rows += mine
    rows.sort(key=warc.key_of)
    low, high = warc.key_of(rows[40]), warc.key_of(rows[-50])
    for a, z, part in ((None, None, rows), (low, high, rows[40:-50]), (None, low, rows[:40]), (high, None, rows[-50:])):
        merge = warc.RangeMerge(warc.block_reader(store, root), blocks, a, z)
        assert list(merge) == part and merge.most <= 9 * 5 and merge.held == 0


def test_revisits_refer_to_records_that_exist(spark):
    folder = new_path(spark, "test-warc")
    pages = spark.createDataFrame(odd_pages(), SCHEMA).repartition(4)
    names = [r.file for r in warc.write_archives(pages, folder).collect()]
    store, root = warc.opened(folder)
    responses, wanted = Counter(), []
    for name in names:
        with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
            for _, _, raw in warc.members(stream):
                head = dict(line.split(": ", 1) for line in raw.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:] if ": " in line)
                if head["WARC-Type"] == "response":
                    responses[head["WARC-Record-ID"]] += 1
                else:
                    wanted.append(head["WARC-Refers-To"])
    assert wanted and set(wanted) <= set(responses)
    # Rows equal in all columns alone share an id.
    equal = Counter((i, u, h or "") for i, u, h in odd_pages())
    assert sum(responses.values()) - len(responses) <= sum(n - 1 for n in equal.values())


def test_archives_are_bounded(spark):
    pages = spark.createDataFrame([(i, "u", "".join(random.Random(i).choices("abcdefgh", k=3000))) for i in range(60)], SCHEMA).coalesce(1)
    manifest = warc.write_archives(pages, new_path(spark, "test-warc"), max_bytes=10_000).collect()
    assert len(manifest) > 5 and all(r.bytes < 13_000 for r in manifest) and sum(r.records for r in manifest) == 60


def f_slice(data):
    import io

    return io.BytesIO(data)


def test_loser_tree():
    rng = random.Random(9)
    for k in range(1, 12):
        runs = [sorted((rng.randrange(50), (i, j)) for j in range(rng.randrange(0, 9))) for i in range(k)]
        merged = list(warc.LoserTree(runs))
        value = {item: key for run in runs for key, item in run}
        assert [value[m] for m in merged] == sorted(value.values()) and len(merged) == len(value)
    assert list(warc.LoserTree([])) == []


def test_url_keys():
    assert warc.url_key("https://www.Example.com/A/b?X=1#y") == "com,example)/a/b?x=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == warc.url_key("") == ""


def test_damage_is_found():
    raw = warc.record(1, "http://a/", b"payload", warc.base32(hashlib.sha1(b"payload").digest()), None, False, "x")
    assert warc.parsed(raw)["payload_bytes"] == 7
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(raw.replace(b"payload\r\n", b"pAyload\r\n"))


def test_empty_table_and_extra_columns(spark):
    assert warc.report(spark.createDataFrame([], SCHEMA)).count() == 0
    pages = spark.createDataFrame([(1, "http://a/", "x")], SCHEMA).withColumns({c: F.lit("z") for c in ("digest", "top", "file", "part", "revisit")})
    assert [tuple(r) for r in warc.report(pages).collect()] == plain([(1, "http://a/", "x")], 0)
