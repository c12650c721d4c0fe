"""A table in ranges of its order, newest first, so that a page opens the few files it comes from.

The rows are dealt to files by ranges of the order columns; beside them lies a small table with the first and last row and the number of rows of each
file. A page looks into that table, opens files from its cursor on, twice as many at each turn, until it is full or there are no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import ArticleFilter, page_limit
from ..operators.library import Page, page_query

#: Files that a page opens first.
FIRST = 2


def write_ranges(rows: DataFrame, folder: str, keys: tuple[str, ...] = ("fetched_at", "id"), files: int = 64) -> None:
    """Write a table into a folder that is not there yet. The bounds come last: a folder without them is not read."""
    order = [F.desc(k) for k in keys]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{folder}/rows")
    back = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows").select(F.col("_metadata.file_path").alias("file"), *keys)
    ends = back.groupBy("file").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"), F.count(F.lit(1)).alias("n"))
    ends.coalesce(1).write.parquet(f"{folder}/bounds")


def _files(spark: SparkSession, folder: str) -> list:
    """A row a file, newest first."""
    found = spark.read.parquet(f"{folder}/bounds").collect()
    return sorted(found, key=lambda r: tuple(r.high), reverse=True)


def ranged_page(spark: SparkSession, folder: str, condition: ArticleFilter | None = None, limit: int = 60, cursor: tuple | None = None, keys: tuple[str, ...] = ("fetched_at", "id")) -> tuple[Page, list[str]]:
    """The page that library_page gives, and the files that were opened for it. Order columns are not null."""
    limit = page_limit(limit)
    left = [r for r in _files(spark, folder) if cursor is None or tuple(r.low) < cursor]
    schema = spark.read.parquet(f"{folder}/rows").schema if left else None
    rows, opened, at, many = [], [], 0, FIRST
    while at < len(left) and len(rows) <= limit:
        part = [r.file for r in left[at : at + many]]
        query = page_query(spark.read.schema(schema).parquet(*part), condition, limit, cursor, keys)
        rows += query.collect()  # a page at most
        opened += part
        at, many = at + many, many * 2
    kept = rows[:limit]
    return Page(kept, len(rows) > limit, tuple(kept[-1][k] for k in keys) if kept else None), opened
