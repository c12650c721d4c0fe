"""Predicates of the library as columns, and the request that combines them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ascii_ci, contains_unicode_ci, instant
from ..schemas import UNCATEGORIZED

TOMBSTONE_DAYS = 60
GRACE_HOURS = 1


@dataclass(frozen=True)
class ArticleFilter:
    """All parts are optional and are joined by AND; tags match any of them."""

    favorites: bool = False
    search: str | None = None
    category: str | None = None
    tags: tuple[str, ...] = ()

    def column(self) -> Column:
        parts = []
        if self.favorites:
            parts.append(F.col("favorited"))
        if self.search and self.search.strip():
            parts.append(contains_ascii_ci("title", self.search.strip()))
        if self.category is not None:
            parts.append(F.col("category_id").isNull() if self.category == UNCATEGORIZED else F.col("category_id") == self.category)
        if self.tags:
            parts.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in self.tags])))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def page_limit(limit: int) -> int:
    return max(1, limit)


def before(cursor: tuple, *columns: str) -> Column:
    """Rows after the cursor in descending order of the columns; a form that reaches the Parquet scan."""
    out, equal = F.lit(False), F.lit(True)
    for name, value in zip(columns, cursor, strict=True):
        out = out | (equal & (F.col(name) < F.lit(value)))
        equal = equal & (F.col(name) == F.lit(value))
    return out


def syncable_sources() -> Column:
    return (F.col("type") == "rss") & F.col("status").isin("active", "error")


def has_tag(tag: str) -> Column:
    return F.array_contains("tags", tag)


def name_contains(name: str, query: str) -> Column:
    """Filter of the lists: Unicode case folding, empty matches all."""
    return contains_unicode_ci(name, query.strip()) if query.strip() else F.lit(True)


def search_scopes(articles: DataFrame, categories: DataFrame, tags: DataFrame, query: str, scope: str = "all") -> dict[str, DataFrame]:
    """Hits by kind; a scope other than "all" has one kind only."""
    kinds = {"articles": articles.where(contains_ascii_ci("title", query.strip())), "categories": categories.where(name_contains("name", query)), "tags": tags.where(name_contains("tag", query))}
    return {k: v for k, v in kinds.items() if scope in ("all", k)}


def active_and_paused(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sources.where("status <> 'paused'"), sources.where("status = 'paused'")


def newer(a: Column, b: Column) -> Column:
    """Whether order a is after b, where a missing b is older than anything."""
    return b.isNull() | (a > b)


def keep_tombstone(deleted_at: str, now: Column, days: int = TOMBSTONE_DAYS) -> Column:
    """Within retention; unparseable times are kept."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(instant(deleted_at)) < days * 86_400_000_000, F.lit(True))


def past_grace(modified: str, now: Column, hours: int = GRACE_HOURS) -> Column:
    """Old enough to be swept; unparseable times are too recent."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(instant(modified)) > hours * 3_600_000_000, F.lit(False))


def ranked_names(names: DataFrame, query: str, limit: int, column: str = "name") -> DataFrame:
    """Exact match first, then prefixes, then the rest that contains the query; by name within a rank."""
    q, c = query.strip().lower(), F.lower(column)
    rank = F.when(c == q, 0).when(F.startswith(c, F.lit(q)), 1).when(F.contains(c, F.lit(q)), 2)
    return names.withColumn("rank", rank).where(F.col("rank").isNotNull()).orderBy("rank", column).limit(limit)
