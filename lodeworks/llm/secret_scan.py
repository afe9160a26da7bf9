"""Secret scans over an incremental blob ledger.

A text is a blob, addressed by its SHA-256; the paths of a blob are the documents that hold it. The ledger is a folder
of two append-only Parquet tables: ``scans`` (blob, the rule versions it was scanned with, what they found) and ``paths``
(every blob that a doc_id has ever held, with the number of the scan that first saw it there). A scan takes each blob
once, leaves out those that the ledger has with every rule version, scans the others with the missing versions alone,
and appends; findings are joined back to the rows of the table, and by ``history`` to all paths of all versions.

That a blob was scanned and what was found stand in one row, so a scan that is stopped at any point loses no finding: a
later one finds the row whole or scans the blob again. Scans side by side only repeat work; repeated rows count once.

Rules are (kind, version, pattern, group whose length counts, least length); matches are leftmost and non-overlapping per
rule, and those too short are dropped. The base rules are ``assign``, ``access`` and ``hex``; the others add spans
(private key headers, GitHub, Slack and JSON web tokens). Spans are code points, end exclusive. Each pattern takes time in
proportion to the text, whatever the text.

Scale: blobs that need a scan are found on digests alone, and a used ledger's texts are fetched for these; a text is
shuffled once, by digest, after each task has dropped its own repeats, so a hot blob reaches its scanner at most once a
task; findings are few and joined back to the narrow path table, with skew handled by the join.

Defined cases: a null text is the empty blob; a null doc_id is a path like any other; repeated rows are paths of one
blob; an empty table gives an empty result; other columns play no part and are kept by ``redact``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import bounded, new_path, remove, stored, text_of

#: kind, version, pattern, group, least length; base rules first.
RULES = (
    ("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    ("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    # From the start of a run of its letters alone: every other place would be tried to the run's end.
    ("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30),
)
BASE = ("assign", "access", "hex")
#: A text without any of these (lower case for assign) has no match, so the pattern is not tried.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",), "private_key": ("PRIVATE KEY",),
         "github": ("gh",), "slack": ("xox",), "jwt": ("eyJ",)}


def compiled(rules: tuple) -> list[tuple]:
    return [(k, f"{k}@{v}", re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)), g, least) for k, v, p, g, least in rules]


def scan_text(text: str, rules: list[tuple]) -> list[tuple[int, int, str]]:
    """(start, end, kind) by rule order, then start."""
    out = []
    lowered = None
    for kind, _, pattern, group, least in rules:
        hints = HINTS.get(kind)
        if hints:
            if kind == "assign":
                lowered = text.lower() if lowered is None else lowered
                if not any(h in lowered for h in hints):
                    continue
            elif not any(h in text for h in hints):
                continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), kind))
    return out


def digest() -> Column:
    return F.unhex(F.sha2(text_of(F.col("text")), 256))


class Ledger:
    """Append-only tables under ``path``; ``path`` None makes a new, empty ledger in the shared folder."""

    SCANS = "blob binary, rules array<string>, found array<struct<rule:string,spans:array<struct<start:int,stop:int>>>>"
    PATHS = "doc_id long, blob binary, scan long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        where = f"{self.path}/{name}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(where) if there else None

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self._read(name, schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def scanned(self) -> DataFrame:
        """blob, rules: one row for each time a blob was scanned."""
        return self._table("scans", self.SCANS).select("blob", "rules")

    def findings(self) -> DataFrame:
        """blob, rule, spans."""
        return self._table("scans", self.SCANS).select("blob", F.explode("found").alias("f")).select("blob", "f.rule", "f.spans")

    def paths(self) -> DataFrame:
        """doc_id, blob, scan: every version that a document has had, and the number (from 1) of the scan that first saw it."""
        return self._table("paths", self.PATHS).groupBy("doc_id", "blob").agg(F.min("scan").alias("scan"))

    def scan(self, docs: DataFrame, rules: tuple = RULES) -> DataFrame:
        """Scans what the ledger has not seen, records the paths, and returns doc_id and blob of every row of docs."""
        now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("blob"))
        wanted = F.array(*[F.lit(f"{k}@{v}") for k, v, *_ in rules])
        known = self._read("scans", self.SCANS)
        texts = docs.select(digest().alias("blob"), text_of(F.col("text")).alias("text"))
        if known is None:
            todo, blobs = None, _once_a_task(texts).select("blob", "text", wanted.alias("todo")).repartition("blob")
        else:
            had = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("had"))
            new = now.select("blob").distinct().join(had, "blob", "left")
            need = F.array_except(wanted, F.coalesce("had", F.array().cast("array<string>"))).alias("todo")
            todo = stored(new.select("blob", need).where(F.size("todo") > 0), "todo")
            few = bounded(todo)
            # Where they are many, the join by shuffle deals the texts by blob already.
            blobs = _once_a_task(texts).join(few if few is not todo else todo.hint("shuffle_hash"), "blob").select("blob", "text", "todo")
            blobs = blobs.repartition("blob") if few is not todo else blobs
        blobs.mapInArrow(_scanner(rules), self.SCANS).write.mode("append").parquet(f"{self.path}/scans")
        if todo is not None:
            remove(todo)
        self._record(now)
        return docs.select("doc_id", digest().alias("blob"))

    def _record(self, now: DataFrame) -> None:
        """Appends the versions of paths that the ledger does not have."""
        old, number = self._read("paths", self.PATHS), 1
        rows = now.distinct()
        if old is not None:
            number += old.agg(F.max("scan")).first()[0] or 0
            there = old.select(F.col("doc_id").alias("d"), F.col("blob").alias("b"))
            rows = rows.join(there, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("blob") == F.col("b")), "left_anti")
        rows.withColumn("scan", F.lit(number).cast("long")).write.mode("append").parquet(f"{self.path}/paths")

    def spans(self, rules: tuple = RULES) -> DataFrame:
        """blob, spans (array of start, stop, kind; by start, then rule order), of blobs with findings of these rules."""
        order = self.spark.createDataFrame([(f"{k}@{v}", k, i) for i, (k, v, *_) in enumerate(rules)], "rule string, kind string, rank int")
        found = self.findings().dropDuplicates(["blob", "rule"]).join(F.broadcast(order), "rule")
        each = found.select("blob", "kind", "rank", F.explode("spans").alias("s"))
        item = F.struct(F.col("s.start").alias("start"), F.col("rank"), F.col("s.stop").alias("stop"), F.col("kind"))
        return each.groupBy("blob").agg(F.sort_array(F.collect_list(item)).alias("spans"))

    def history(self, rules: tuple = RULES) -> DataFrame:
        """doc_id, blob, scan, spans of every path that ever held a blob with findings, whether or not it does now."""
        return self.paths().join(self.spans(rules), "blob").select("doc_id", "blob", "scan", "spans")


def _once_a_task(blobs: DataFrame) -> DataFrame:
    """Drops repeats within a task: a hot blob is shuffled once by each task that reads it. Forgets all after some rows, so memory is bounded."""

    def kernel(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for key in batch.column(0).to_pylist():
                keep.append(key not in seen)
                seen.add(key)
            if len(seen) > 500_000:
                seen.clear()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return blobs.mapInArrow(kernel, blobs.schema)


def _scanner(rules: tuple):
    """Rows of SCANS from (blob, text, todo)."""
    out_type = pa.list_(pa.struct([("rule", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))

    def kernel(batches):
        ready = compiled(rules)
        seen: set[bytes] = set()  # a partition has all rows of its blobs
        for batch in batches:
            blob, done, found = [], [], []
            for key, text, todo in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                by_rule: dict[str, list] = {}
                need = [r for r in ready if r[1] in todo]
                names = {r[0]: r[1] for r in need}
                for start, stop, kind in scan_text(text.as_py(), need):
                    by_rule.setdefault(names[kind], []).append({"start": start, "stop": stop})
                blob.append(key)
                done.append(todo)
                found.append([{"rule": r, "spans": s} for r, s in by_rule.items()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blob, pa.binary()), pa.array(done, pa.list_(pa.string())), pa.array(found, out_type)],
                names=["blob", "rules", "found"],
            )

    return kernel


def report(docs: DataFrame, ledger: Ledger | None = None, rules: tuple = RULES) -> DataFrame:
    """Per document: spans of each base kind, the digest of the base spans, and all spans as text."""
    ledger = ledger or Ledger(docs.sparkSession)
    paths = ledger.scan(docs, rules)
    found = ledger.spans(rules)

    def count(kind):
        return F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    blobs = found.select(
        "blob", *[count(k).alias(f"n_{k}") for k in BASE],
        listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))).alias("base"), listed(F.col("spans")).alias("spans"),
    )
    joined = paths.join(bounded(stored(blobs, "findings"), ("spans", "base")), "blob", "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sha2(F.encode(F.coalesce("base", F.lit("")), "UTF-8"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, ledger: Ledger | None = None, rules: tuple = RULES) -> DataFrame:
    """docs with each found span of text replaced by [kind] (overlapping spans by the first one's); n_chars follows it."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, rules)
    spans = stored(ledger.spans(rules).withColumn("width", F.to_json("spans")), "spans")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest().alias("blob"))
    joined = whole.join(bounded(spans, ("width",)).drop("width"), "blob", "left")

    def step(acc, s):
        later = s["stop"] > acc["at"]
        # A span that starts before the last one's end only widens it.
        apart = s["start"] >= acc["at"]
        gap = F.substring(F.col("row.text"), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(later & apart, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(later, s["stop"]).otherwise(acc["at"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("row.text"), acc["at"] + 1, F.char_length("row.text"))))
    done = joined.select("row", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(clean).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
