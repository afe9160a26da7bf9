"""WARC archives of pages, read back into a globally ordered capture index by an external merge.

Writing: equal payloads (html in UTF-8) are found by their SHA-1. Of a group of at least ``min_bytes`` bytes the record
with the largest page_id is a response, the others are revisits that refer to its record id and hold no payload. Record ids
are made from what a record is (page, URL, payload, type), so that tasks agree on them. Each task writes archives of gzip
members, of about ``max_bytes`` at most, to the shared folder; a manifest, committed by Spark, lists the archives that count,
so a task that failed or ran twice adds none.

Reading: each archive is parsed record by record (a response's length and digest are taken from its bytes); index rows are
sorted by URL key, timestamp, page_id and place, ``RUN_ROWS`` at a time, and written as runs: files of blocks of
``BLOCK_ROWS`` rows, with a sparse index (first and last key of each block) as a table.

External index merge: runs are merged ``fan_in`` at a time until one is left; the last pass yields the result. A pass cuts
the keys of each group of runs into ranges, at quantiles of a bounded sample of block keys, and a task merges one range: it
opens the blocks that the sparse index names, holds one block of each run, and merges them with a loser tree. Nothing is
sorted after the runs are, and a task holds at most ``fan_in`` + 1 blocks, whatever the range. A hot URL spreads, as time, page
and place are part of the key. Ranges in order, and rows in order within them (part, seq), make the capture histories
globally ordered.

Hot payloads are counted by partial aggregation; the table of repeated payloads is narrow and joined by broadcast when
counted small, else by a skew-handled join.

Defined cases: null html is an empty payload; a null page_id is smaller than all ids; rows that repeat the largest id of
their payload are all responses; rows equal in id, URL and payload are one record written several times, under one record id; a
null url has the empty key; a capture's time is the start time plus page_id seconds (modulo ten years); an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import dense_ids
from lodeworks.llm.common import bounded, new_path, remove, remove_path, stored

START = datetime(2020, 1, 1, tzinfo=UTC)
SPAN = 10 * 365 * 86_400
INDEX = (
    "urlkey string, ts string, page_id long, url string, payload_digest string, payload_bytes long, record_type string, "
    "refers_to long, file string, offset long, length long"
)
FIELDS = [x.split()[0] for x in INDEX.split(", ")]
AT = [FIELDS.index(c) for c in ("urlkey", "ts", "page_id", "file", "offset")]
ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in INDEX.split(", ")])
#: Rows that a task sorts at once, rows of a block, runs that are merged at once, rows of a range, block keys sampled for the cuts.
RUN_ROWS, BLOCK_ROWS, FAN_IN, RANGE_ROWS, SAMPLE = 50_000, 512, 64, 200_000, 50_000
KEY = "struct<urlkey:string,ts:string,page:long,file:string,offset:long>"
BLOCKS = f"run string, segment int, file string, block int, n int, low {KEY}, high {KEY}"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path and query, lower-cased; scheme, www, default port and fragment go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    place = ",".join(reversed(host.split("."))) if host else ""
    if port and port not in (80, 443):
        place += f":{port}"
    return f"{place}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def clean(value: str) -> str:
    """A header value in one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, url: str | None, digest: str, is_revisit: bool) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, digest, is_revisit)))}"


def date_of(page_id: int | None) -> str:
    return f"{START + timedelta(seconds=(page_id or 0) % SPAN):%Y-%m-%dT%H:%M:%SZ}"


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, is_revisit: bool, name: str, refers_url: str | None = None
) -> bytes:
    """One WARC record, of id name. refers, refers_url: page and URL of a revisit's response."""
    block = HTTP % len(payload) if is_revisit else HTTP % len(payload) + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date_of(page_id)}",
        f"WARC-Target-URI: {clean(url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-X-Page: {'' if page_id is None else page_id}",
        f"WARC-X-No-Target: {int(url is None)}",
    ]
    if is_revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(refers, refers_url, digest, False)}>",
            f"WARC-Refers-To-Target-URI: {clean(refers_url or '')}",
            f"WARC-Refers-To-Date: {date_of(refers)}",
            f"WARC-X-Refers-To-Page: {refers}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict[str, Any]:
    """The index fields of one record, but its place."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    size = int(http.rpartition(b": ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        size, found = len(payload), base32(hashlib.sha1(payload).digest())
        if found != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    page, refers = fields.get("WARC-X-Page", ""), fields.get("WARC-X-Refers-To-Page", "")
    url = None if fields.get("WARC-X-No-Target") == "1" else fields["WARC-Target-URI"]
    return {
        "urlkey": url_key(url), "ts": "".join(c for c in fields["WARC-Date"] if c.isdigit()), "page_id": int(page) if page else None,
        "url": url, "payload_digest": digest, "payload_bytes": size, "record_type": kind,
        "refers_to": int(refers) if refers else None,
    }


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, digest (hex), refers_to, refers_url, revisit."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    repeated = (
        rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("top.page_id").isNotNull()).select("digest", F.col("top.page_id").alias("top"), F.col("top.url").alias("top_url"))
    )
    joined = rows.join(bounded(stored(repeated, "repeated"), ("digest", "top_url")), "digest", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    refers = [F.when(revisit, F.col(c)).alias(name) for c, name in (("top", "refers_to"), ("top_url", "refers_url"))]
    return joined.select("page_id", "url", "html", "digest", *refers, revisit.alias("revisit"))


def opened(folder: str):
    """File system and path of a folder, for the workers' own reads and writes: local or mounted, HDFS, S3, GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + folder[folder.index(":") :] if folder.startswith(("s3a:", "s3n:")) else folder)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 1, max_bytes: int = 1 << 30) -> DataFrame:
    """Writes the archives to folder and returns the stored manifest: file, records, bytes."""

    def kernel(batches):
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0

        def ended():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers, refers_url, again = (c[i].as_py() for c in columns)
                digest = base32(bytes.fromhex(digest))
                raw = record(page_id, url, html.encode("utf-8"), digest, refers, again, record_id(page_id, url, digest, again), refers_url)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                n += 1
                size += len(member)
                if size >= max_bytes:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()

    rows = with_revisits(pages, min_bytes)
    return stored(rows.mapInArrow(kernel, "file string, records long, bytes long"), "manifest")


def members(stream):
    """(offset, length, content) of each gzip member of a stream."""
    at, pending, unpacker, parts, used = 0, b"", None, [], 0
    while True:
        if not pending:
            pending = stream.read(1 << 20)
            if not pending:
                if unpacker is not None:
                    raise ValueError("the archive ends within a record")
                return
        if unpacker is None:
            unpacker, parts, used = zlib.decompressobj(31), [], 0
        before = len(pending)
        parts.append(unpacker.decompress(pending))
        pending = unpacker.unused_data
        used += before - len(pending)
        if unpacker.eof:
            yield at, used, b"".join(parts)
            at += used
            unpacker = None


def key_of(row: tuple) -> tuple:
    """A row's place in the global order; a row is a tuple of FIELDS."""
    urlkey, ts, page, file, offset = (row[i] for i in AT)
    return urlkey, ts, -1 << 63 if page is None else page, file, offset


def batch_of(rows: list[tuple], schema: pa.Schema = ARROW) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class SegmentWriter:
    """Sorted rows into a file of blocks. index: the rows of BLOCKS that tell what it holds."""

    def __init__(self, store, root: str, run: str, segment: int, block_rows: int):
        self.run, self.segment, self.block_rows = run, segment, block_rows
        self.file, self.held, self.index = f"{uuid.uuid4().hex}.arrow", [], []
        self.stream = store.open_output_stream(f"{root}/{self.file}", compression=None)
        self.writer = pa.ipc.new_file(self.stream, ARROW)

    def add(self, row: tuple) -> None:
        self.held.append(row)
        if len(self.held) >= self.block_rows:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_batch(batch_of(self.held))
            low, high = (dict(zip(("urlkey", "ts", "page", "file", "offset"), key_of(self.held[i]))) for i in (0, -1))
            block = {"run": self.run, "segment": self.segment, "file": self.file, "block": len(self.index), "n": len(self.held), "low": low, "high": high}
            self.index.append(block)
            self.held = []

    def close(self) -> list[dict]:
        self._flush()
        self.writer.close()
        self.stream.close()
        return self.index


KEY_TYPE = pa.struct([("urlkey", pa.string()), ("ts", pa.string()), ("page", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
BLOCK_TYPE = pa.schema([
    ("run", pa.string()), ("segment", pa.int32()), ("file", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("low", KEY_TYPE), ("high", KEY_TYPE),
])


def read_runs(manifest: DataFrame, folder: str, to: str, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Writes the index rows of all archives as sorted runs to the folder ``to`` and returns their blocks. Archives are dealt by number."""

    def kernel(batches):
        store, root = opened(folder)
        runs, place = opened(to)
        runs.create_dir(place, recursive=True)

        def written(rows):
            rows.sort(key=key_of)
            out = SegmentWriter(runs, place, uuid.uuid4().hex, 0, block_rows)
            for row in rows:
                out.add(row)
            return pa.RecordBatch.from_pylist(out.close(), schema=BLOCK_TYPE)

        rows: list[tuple] = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, length, raw in members(stream):
                        found = parsed(raw) | {"file": name, "offset": offset, "length": length}
                        rows.append(tuple(found[c] for c in FIELDS))
                        if len(rows) >= run_rows:
                            yield written(rows)
                            rows = []
        if rows:
            yield written(rows)

    n = max(1, manifest.count())
    tasks = min(n, 10_000)
    numbered = dense_ids(manifest, "file", "at").select("file", (F.col("at") % tasks).cast("int").alias("at"))
    return numbered.repartitionById(tasks, F.col("at")).select("file").mapInArrow(kernel, BLOCKS)


class LoserTree:
    """k-way merge of sorted streams of (key, item): each inner node holds the loser of its match, the root the winner."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(run) for run in runs]
        self.heads = [next(run, None) for run in self.runs]
        self.k = max(1, len(self.runs))
        self.losers = [-1] * self.k
        winners = [-1] * (2 * self.k)
        for i in range(len(self.runs)):
            winners[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else (0 if self.runs else -1)

    def _head(self, i: int):
        return self.heads[i] if i >= 0 else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and x[0] <= y[0])

    def __iter__(self):
        while (head := self._head(self.winner)) is not None:
            yield head[1]
            i = self.winner
            self.heads[i] = next(self.runs[i], None)
            node = (self.k + i) >> 1
            while node:
                if not self._before(i, self.losers[node]):
                    i, self.losers[node] = self.losers[node], i
                node >>= 1
            self.winner = i


class RangeMerge:
    """Rows from low (None: the first) to before high (None: the last) of runs, in order. blocks: run -> (file, block) in order.

    Holds one block of each run; most: rows held at once, at most."""

    def __init__(self, read: Callable[[str, int], list[tuple]], blocks: dict[str, list[tuple[str, int]]], low: tuple | None, high: tuple | None):
        self.read, self.blocks, self.low, self.high = read, blocks, low, high
        self.held = self.most = 0

    def _rows(self, blocks: list[tuple[str, int]]) -> Iterator[tuple]:
        for file, block in blocks:
            rows = self.read(file, block)
            self.held += len(rows)
            self.most = max(self.most, self.held)
            for row in rows:
                key = key_of(row)
                if self.high is not None and key >= self.high:
                    break
                if self.low is None or key >= self.low:
                    yield key, row
            self.held -= len(rows)

    def __iter__(self) -> Iterator[tuple]:
        return iter(LoserTree([self._rows(blocks) for _, blocks in sorted(self.blocks.items())]))


def block_reader(store, root: str) -> Callable[[str, int], list[tuple]]:
    """Rows of a block of a file; files stay open until the task ends."""
    opened_files: dict[str, pa.ipc.RecordBatchFileReader] = {}

    def read(file: str, block: int) -> list[tuple]:
        if file not in opened_files:
            opened_files[file] = pa.ipc.open_file(store.open_input_file(f"{root}/{file}"))
        return list(zip(*(c.to_pylist() for c in opened_files[file].get_batch(block).columns)))

    return read


def plan_pass(blocks: DataFrame, fan_in: int, range_rows: int) -> tuple[dict[str, int], list[list[tuple]]]:
    """Group of each run, and the cut keys of each group's ranges, from a bounded sample of block keys.

    The driver holds a name a run and at most about SAMPLE keys."""
    spark = blocks.sparkSession
    runs = blocks.groupBy("run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).orderBy("run").collect()
    groups = math.ceil(len(runs) / fan_in)
    group_of = {r.run: i // fan_in for i, r in enumerate(runs)}
    rows = [0] * groups
    for r in runs:
        rows[group_of[r.run]] += r.n
    total = sum(r.blocks for r in runs)
    part = F.pmod(F.xxhash64("file", "block"), F.lit(max(1, math.ceil(total / SAMPLE)))) == 0
    keys: list[list[tuple]] = [[] for _ in range(groups)]
    for r in blocks.where(part).select("run", "low").collect():
        keys[group_of[r.run]].append(tuple(r.low))
    least = math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / max(1, groups))
    cuts = []
    for mine, n in zip(keys, rows):
        mine.sort()
        ranges = max(least, math.ceil(n / range_rows))
        cuts.append(sorted({mine[i * len(mine) // ranges] for i in range(1, ranges)}) if mine else [])
    return group_of, cuts


def merge_pass(blocks: DataFrame, source: str, target: str | None, group_of: dict[str, int], cuts: list[list[tuple]], block_rows: int) -> DataFrame:
    """One task a range: target None: INDEX and part, seq, else segments of one run a group in the folder target, and their blocks."""
    firsts = [0]
    for c in cuts:
        firsts.append(firsts[-1] + len(c) + 1)

    def dealt(batches):
        # A block goes to every range that its keys reach.
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                g = group_of[r["run"]]
                low, high = (bisect_right(cuts[g], tuple(r[k].values())) for k in ("low", "high"))
                out += [(firsts[g] + k, r["run"], r["segment"], r["file"], r["block"]) for k in range(low, high + 1)]
            columns = list(zip(*out)) if out else [[]] * 5
            types = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["task", "run", "segment", "file", "block"])

    schema = ARROW.append(pa.field("part", pa.int32())).append(pa.field("seq", pa.int64()))

    def kernel(batches):
        slices: dict[int, dict[str, list]] = {}
        for batch in batches:
            for task, run, segment, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                slices.setdefault(task, {}).setdefault(run, []).append((segment, block, file))
        store, root = opened(source)
        for task, runs in sorted(slices.items()):
            g = bisect_right(firsts, task) - 1
            k = task - firsts[g]
            low, high = cuts[g][k - 1] if k else None, cuts[g][k] if k < len(cuts[g]) else None
            merged = RangeMerge(block_reader(store, root), {run: [(f, b) for _, b, f in sorted(found)] for run, found in runs.items()}, low, high)
            if target is None:
                held = []
                for seq, row in enumerate(merged):
                    held.append((*row, k, seq))
                    if len(held) >= 10_000:
                        yield batch_of(held, schema)
                        held = []
                if held:
                    yield batch_of(held, schema)
            else:
                into, place = opened(target)
                into.create_dir(place, recursive=True)
                out = SegmentWriter(into, place, f"group-{g}", k, block_rows)
                for row in merged:
                    out.add(row)
                yield pa.RecordBatch.from_pylist(out.close(), schema=BLOCK_TYPE)

    needed = blocks.select("run", "segment", "file", "block", "low", "high").mapInArrow(dealt, "task int, run string, segment int, file string, block int")
    return needed.repartitionById(firsts[-1], F.col("task")).mapInArrow(kernel, INDEX + ", part int, seq long" if target is None else BLOCKS)


def merged_index(blocks: DataFrame, folder: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """INDEX and part, seq, stored: the rows of all runs in global order. blocks: a stored table of the runs in folder."""
    while True:
        group_of, cuts = plan_pass(blocks, fan_in, range_rows)
        last = len(cuts) <= 1
        target = None if last else new_path(blocks.sparkSession, "runs")
        out = stored(merge_pass(blocks, folder, target, group_of, cuts or [[]], block_rows), "captures" if last else "blocks")
        remove(blocks)
        remove_path(blocks.sparkSession, folder)
        if last:
            return out
        blocks, folder = out, target


def capture_index(
    pages: DataFrame, min_bytes: int = 0, folder: str | None = None, fan_in: int = FAN_IN, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS,
    range_rows: int = RANGE_ROWS, max_bytes: int = 1 << 30,
) -> DataFrame:
    """Writes pages to archives, reads them back, and returns the merged index."""
    spark = pages.sparkSession
    folder, runs = folder or new_path(spark, "warc"), new_path(spark, "runs")
    manifest = write_archives(pages, folder, min_bytes, max_bytes=max_bytes)
    return merged_index(stored(read_runs(manifest, folder, runs, run_rows, block_rows), "blocks"), runs, fan_in, range_rows, block_rows)


def report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page."""
    return capture_index(pages, min_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
