"""Writers of the report formats, to any file system that Spark reaches. Lines are made by plans; what reaches the driver are
the small JSON reports, and the itemset report a row at a time."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.storage import write_text


def write_json_document(report: dict[str, Any], path: str, spark: SparkSession | None = None) -> None:
    """One JSON document, indented by four."""
    write_text(spark or SparkSession.active(), path, [json.dumps(report, indent=4)])


def _lines(df: DataFrame, line: Column, order: list, path: str) -> None:
    """Lines in global order, as text part files whose names follow that order."""
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def write_averages(df: DataFrame, path: str) -> None:
    """``city,avg`` lines without header or quotes, best first."""
    _lines(df, F.concat_ws(",", "city", F.col("avg_stars").cast("string")), [F.desc("avg_stars"), "city"], path)


def quoted(item: Column) -> Column:
    return F.concat(F.lit("'"), item, F.lit("'"))


def itemset_text(items: Column) -> Column:
    """('a') for one item, ('a', 'b') for more."""
    return F.concat(F.lit("("), F.array_join(F.transform(items, quoted), ", "), F.lit(")"))


def itemset_report(itemsets: DataFrame, label: str) -> DataFrame:
    """section, size, line: one line a size, itemsets in order of their items, comma-joined."""
    text = itemsets.select(F.size("items").alias("size"), F.struct("items", itemset_text(F.col("items")).alias("t")).alias("s"))
    joined = text.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), ",").alias("line"))
    return joined.select(F.lit(label).alias("section"), "size", "line")


def write_itemset_report(sections: list[DataFrame], path: str) -> None:
    """Sections of itemset_report: each one's label, then a line and a blank line a size. The lines (one a size) come to the driver."""

    def chunks():
        for section in sections:
            for i, row in enumerate(section.orderBy("size").collect()):
                yield (f"{row.section}:\n" if i == 0 else "") + row.line + "\n\n"

    write_text(sections[0].sparkSession, path, chunks())


def write_itemsets(sections: list[tuple[str, DataFrame]], path: str) -> None:
    """The same text of (label, itemsets) for any number of itemsets: sorted itemsets come to the driver partition by partition and go
    on to the file, so that neither it nor a task holds a line."""

    def chunks():
        for label, itemsets in sections:
            last = None
            rows = itemsets.select(F.size("items").alias("size"), "items", itemset_text(F.col("items")).alias("t")).orderBy("size", "items")
            for row in rows.toLocalIterator():
                if row.size == last:
                    yield "," + row.t
                else:
                    yield (f"{label}:\n" if last is None else "\n\n") + row.t
                last = row.size
            if last is not None:
                yield "\n\n"

    write_text(sections[0][1].sparkSession, path, chunks())


def write_spaced_csv(df: DataFrame, path: str) -> None:
    """CSV with a header whose later names start with a space, \\r\\n line ends, minimal quoting."""
    named = df.toDF(df.columns[0], *[f" {c}" for c in df.columns[1:]])
    named.write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\r\n")


def write_edges(df: DataFrame, path: str) -> None:
    """``('u', 'v'), value`` lines, largest value first."""
    line = F.concat(F.lit("("), quoted(F.col("src")), F.lit(", "), quoted(F.col("dst")), F.lit("), "), F.col("betweenness").cast("string"))
    _lines(df, line, [F.desc("betweenness"), "src", "dst"], path)


def write_communities(df: DataFrame, path: str) -> None:
    """``'a', 'b'`` lines, smallest community first."""
    _lines(df, F.array_join(F.transform("members", quoted), ", "), [F.size("members"), F.element_at("members", 1)], path)


def write_clustering(rounds: DataFrame, labels: DataFrame, path: str) -> None:
    """Two folders: round summaries and pid,label lines by pid."""
    line = F.format_string("Round %d: %d,%d,%d,%d", "round", "ds_points", "cs_clusters", "cs_points", "rs_points")
    _lines(rounds, line, ["round"], f"{path}/rounds")
    _lines(labels, F.concat_ws(",", "pid", "label"), ["pid"], f"{path}/labels")
