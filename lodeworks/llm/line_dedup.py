"""Line dedup by levelled sorted runs of line hashes, in DataFrame operations alone.

A line's key is the line without white space at both ends, A-Z lower-cased; a key travels as two 64-bit hashes. A
batch of documents becomes a run: its distinct keys, each with the number of the batch's documents that hold it, bucketed
and sorted by hash. ``LineRuns.add`` first takes from a new batch, by sort-merge anti-join, the keys that one of the runs has
already shown to be common (in ``min_docs`` documents), then adds the rest as a run of level 0. When a level holds
``fan_in`` runs, they are compacted to one sorted run of the next level, which adds up the counts. ``common`` merges
what levels are left. All runs have the same buckets, so a batch is shuffled once and no run ever is: anti-joins,
compactions and the last merge read buckets side by side.

Runs live under a path and outlast a call: a later call over the same path counts on. What counts are the runs of the newest
manifest, which is written when a whole call's batches are in, so a call that is stopped has counted nothing. A run is a
Parquet table in the shared folder, so a lost executor costs no run.

``drop_common_lines`` then takes the common lines out of each text. Where the common keys are few (counted), their hashes
are part of the plan and each text is treated where it lies; else each document's positions of common lines are found by join,
and its text, shuffled once, is rebuilt from the slices between them. The rows that are shuffled for counting are hashes;
counts are combined before each shuffle.

Defined cases: a null or empty text is one empty line; empty keys are never common; each row is a document, also where
rows or ids repeat; a null doc_id stays null; an empty table gives an empty result; other columns play no part and are
kept by ``drop_common_lines``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import SPACE, ascii_lower, bounded, new_path, remove, stored, text_of

BATCHES = 4
FAN_IN = 2
KEY = ["h1", "h2"]
#: Common keys up to which their hashes are part of the plan. More are joined.
IN_PLACE = 4096
#: Files of a bucketed run are sorted, one a bucket; with this setting the plan knows it and does not sort them again.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def lowered_lines(text: Column) -> Column:
    """Lines of text, A-Z lower-cased; lower-casing moves no line end."""
    return F.split(ascii_lower(text), "\n")


def line_key(lowered_line: Column) -> Column:
    return F.btrim(lowered_line, F.lit(SPACE))


def hashed(key: Column) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Levels of runs (h1, h2, n): a key and the number of documents it was found in. path None: a new folder, for one call."""

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = FAN_IN, path: str | None = None, buckets: int | None = None):
        self.spark, self.min_docs, self.fan_in, self.path = spark, min_docs, fan_in, path or new_path(spark, "runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.version, self._old, self._made, self._named = 0, [], [], {}
        for version in reversed(self._versions()):
            kept = spark.read.parquet(f"{self.path}/manifest-{version:09d}").collect()
            self.version, self.buckets = version, kept[0].buckets
            for r in sorted((r for r in kept if r.run is not None), key=lambda r: (r.level, r.place)):
                self._level(r.level).append(r.run)
            break

    def _files(self):
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = jvm(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder, jvm

    def _versions(self) -> list[int]:
        """Numbers of the manifests that were written to the end."""
        fs, folder, jvm = self._files()
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and fs.exists(jvm(f"{self.path}/{n}/_SUCCESS")))

    def _level(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _table(self, run: str) -> str:
        """The run's name in this session's catalogue, which tells the plan of its buckets."""
        if run not in self._named:
            self._named[run] = f"lodeworks_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self._named[run]} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) "
                f"SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'"
            )
        return self._named[run]

    def frame(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def _written(self, rows: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        before = self.spark.conf.get(ORDERED, "false")
        self.spark.conf.set(ORDERED, "true")
        try:
            rows.write.insertInto(self._table(run))
        finally:
            self.spark.conf.set(ORDERED, before)
        self._made.append(run)
        return run

    def _put(self, level: int, rows: DataFrame) -> None:
        runs = self._level(level)
        runs.append(self._written(rows))
        if len(runs) >= self.fan_in:
            self.levels[level] = []
            self._put(level + 1, self._merged(runs))
            self._old += runs

    def _merged(self, runs: list[str]) -> DataFrame:
        """Merge joins, two runs at a time, as a join's result has no buckets to go on with."""
        while len(runs) > 2:
            first = self._written(self._merged(runs[-2:]))
            self._old.append(first)
            runs = [*runs[:-2], first]
        if len(runs) == 1:
            return self.frame(runs[0])
        one, two = (self.frame(run).withColumnRenamed("n", f"n{i}") for i, run in enumerate(runs))
        both = one.join(two.hint("merge"), KEY, "full_outer")
        return both.select(*KEY, (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"))

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch without the keys that a run has in min_docs documents."""
        rows = batch.select(*KEY, "n").repartition(self.buckets, *KEY)
        for level in self.levels:
            for run in level:
                known = self.frame(run).where(F.col("n") >= self.min_docs).select(*KEY)
                rows = rows.join(known.hint("merge"), KEY, "left_anti")
        return rows

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n), each key once."""
        self._put(0, self.unseen(batch))

    def common(self) -> DataFrame:
        """Keys found in at least min_docs documents, as a stored table."""
        runs = [run for level in reversed(self.levels) for run in level]
        if not runs:
            return stored(self.spark.createDataFrame([], "h1 long, h2 long"), "common")
        return stored(self._merged(runs).where(F.col("n") >= self.min_docs).select(*KEY), "common")

    def commit(self) -> None:
        """From now on the runs as they are count, and those compacted into others go."""
        rows = [(i, k, run, self.buckets) for i, level in enumerate(self.levels) for k, run in enumerate(level)] or [(None, None, None, self.buckets)]
        self.version += 1
        manifest = self.spark.createDataFrame(rows, "level int, place int, run string, buckets int")
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest-{self.version:09d}")
        self._drop(self._old)
        self._old, self._made = [], []

    def _drop(self, runs: list[str]) -> None:
        fs, _, jvm = self._files()
        for run in runs:
            if run in self._named:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._named.pop(run)}")
            fs.delete(jvm(f"{self.path}/{run}"), True)

    def close(self) -> None:
        """Runs that no manifest has go, and the others' names leave the catalogue."""
        self._drop(self._made)
        for name in self._named.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._made, self._named = [], {}


def common_keys(docs: DataFrame, min_docs: int, min_chars: int, batches: int = BATCHES, path: str | None = None) -> DataFrame:
    """Hashes of the keys of at least min_chars code points that at least min_docs rows hold, of docs and of what calls before added to path."""
    text = text_of(F.col("text"))
    keys = F.array_distinct(F.transform(lowered_lines(text), line_key))
    found = docs.select(F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("b"), F.explode(keys).alias("k"))
    counts = (
        found.where(F.char_length("k") >= max(1, min_chars)).select("b", *hashed(F.col("k")))
        .groupBy("b", *KEY).agg(F.count(F.lit(1)).alias("n"))
    )
    incoming = stored(counts, "batches", "b")
    runs = LineRuns(docs.sparkSession, min_docs, path=path)
    try:
        for b in range(batches):
            runs.add(incoming.where(F.col("b") == b).drop("b"))
        out = runs.common()
        if path:
            runs.commit()
    finally:
        runs.close()
        remove(incoming)
    return out


def kept_in_place(docs: DataFrame, keys: list, min_chars: int) -> DataFrame:
    """with_kept_lines for few common keys: map-only."""

    def common(line: Column) -> Column:
        key = line_key(ascii_lower(line))
        one, two = hashed(key)
        return (F.char_length(key) >= max(1, min_chars)) & one.isin([r.h1 for r in keys]) & two.isin([r.h2 for r in keys])

    lines = F.split(text_of(F.col("text")), "\n")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lines.alias("lines"))
    both = whole.select("row", F.size("lines").cast("long").alias("n_lines"), F.filter("lines", lambda x: ~common(x)).alias("left") if keys else F.col("lines").alias("left"))
    return both.select("row", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept"))


def with_kept_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, path: str | None = None) -> DataFrame:
    """Columns row (struct of all columns of docs), n_lines, n_dropped, kept (the text without common lines)."""
    common = common_keys(docs, min_docs, min_chars, path=path)
    few = common.limit(IN_PLACE + 1).collect()
    return kept_in_place(docs, few, min_chars) if len(few) <= IN_PLACE else kept_by_join(docs, bounded(common), min_chars)


def kept_by_join(docs: DataFrame, common: DataFrame, min_chars: int) -> DataFrame:
    """with_kept_lines for any number of common keys."""
    text = text_of(F.col("text"))
    who = [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("k2")]
    lines = docs.select(*who, F.posexplode(lowered_lines(text)).alias("at", "line"))
    lines = lines.select("k1", "k2", "at", line_key(F.col("line")).alias("k"))
    lines = lines.where(F.char_length("k") >= max(1, min_chars)).select("k1", "k2", "at", *hashed(F.col("k")))
    hits = lines.join(common, KEY, "left_semi").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("cut"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *who)
    joined = rows.join(hits.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "cut")
    lines_of = F.split(text_of(F.col("row.text")), "\n")
    # Slices between neighbouring cuts; the split is evaluated once, as the argument of the outer transform.
    bounds = F.concat(F.array(F.lit(-1)), F.col("cut"), F.array(F.col("n_lines")))
    parts = F.flatten(F.transform(F.array(lines_of), lambda ls: F.flatten(
        F.transform(F.arrays_zip(F.slice(bounds, 1, F.size("cut") + 1).alias("a"), F.slice(bounds, 2, F.size("cut") + 1).alias("z")),
                    lambda s: F.slice(ls, s["a"] + 2, s["z"] - s["a"] - 1)))))
    counted = joined.withColumn("n_lines", F.size(lines_of)).withColumn("n_dropped", F.coalesce(F.size("cut"), F.lit(0)))
    kept = F.when(F.col("cut").isNull(), text_of(F.col("row.text"))).otherwise(F.array_join(parts, "\n"))
    return counted.select("row", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept."""
    out = with_kept_lines(docs.select("doc_id", "text"), min_docs, min_chars, path)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, path: str | None = None) -> DataFrame:
    """docs with the common lines taken out of text (n_chars follows it). path: runs of earlier calls, which count too; docs are added."""
    out = with_kept_lines(docs, min_docs, min_chars, path)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
