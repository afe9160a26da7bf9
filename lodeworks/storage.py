"""Shared storage and size-checked broadcasts.

Loops and multi-step operators cut their lineage with tables written to the folder that driver and executors share, so
that a lost executor costs no work done before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that this process has handed out and not deleted.
_kept: list[str] = []
#: Paths handed out within the innermost settled() of this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Rows and bytes up to which a counted table is broadcast. Larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: Setting by which Spark deletes the shuffle files of a query that has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a local one serves a local master;
    on a cluster each executor would write to a disk of its own, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        path = "file:///tmp/checkpoints"
    return path.rstrip("/") + "/lodeworks"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has; clear() deletes what is written there."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _kept.append(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def stored(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and no executor is needed for it.

    The shuffle files of the write are deleted with its end, not when the driver happens to collect its garbage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes what is under a path, if anything is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _kept:
        _kept.remove(path)


def kept(stored_table: DataFrame) -> bool:
    """Whether a table made by stored() has not been deleted."""
    return stored_table.stored_at in _kept


def write_text(spark: SparkSession, path: str, chunks: Iterable[str]) -> None:
    """One text file on any file system that Spark reaches, chunk by chunk."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        held, size = [], 0
        for chunk in chunks:
            held.append(chunk)
            size += len(chunk)
            if size >= 1 << 20:
                out.write("".join(held).encode("utf-8"))
                held, size = [], 0
        if held:
            out.write("".join(held).encode("utf-8"))
    finally:
        out.close()


def remove(stored_table: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    remove_path(stored_table.sparkSession, stored_table.stored_at)


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """stored() of what make() returns. All other tables that were stored for it are deleted once it is written: nothing reads them
    any more. Tables stored before stay; if make() fails, what it stored is left to clear()."""
    outer, mine = _made.get(), []
    token = _made.set(mine)
    try:
        out = stored(make(), tag)
    finally:
        _made.reset(token)
        if outer is not None:
            outer.extend(mine)
    for path in mine:
        if path != out.stored_at and path in _kept:
            remove_path(out.sparkSession, path)
    return out


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has stored: for the end of a program, when every result has been written."""
    for path in list(_kept):
        remove_path(spark, path)


def bounded(df: DataFrame, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """df, marked for broadcast if its counted rows and string bytes are within the bounds; else df itself, joined by shuffle."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_columns), F.lit(0))
    n, width = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and width <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """table(), dealt out to all cores where its files cannot be split into as many tasks; large tables stay as they are."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 32) else df
