"""Reading the library: scans, lookups, keyset pages, facets, counts and top lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, clamp, nearest
from ..schemas import SUMMARY, UNCATEGORIZED, UNCATEGORIZED_NAME
from .filters import ArticleFilter, before, page_limit

#: Sides of at most this many bytes, as Catalyst estimates them, are broadcast.
SMALL_SIDE = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast if the plan's own size estimate is small; the planner decides otherwise."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= SMALL_SIDE else df


def with_category(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Articles with their category's name and icon; articles without one stay."""
    side = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"), F.col("icon").alias("category_icon"))
    return articles.join(small(side), "category_id", "left")


def list_articles(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """All library rows, newest first."""
    rows = articles.select(*[c for c in SUMMARY if c in articles.columns])
    return with_category(rows, categories).orderBy(F.desc("fetched_at"))


def export_rows(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """The rows of the library's own CSV, newest first."""
    rows = articles.select("title", "link", "category_id", "tags", "fetched_at", "favorited")
    named = with_category(rows, categories)
    out = named.select("title", F.col("link").alias("url"), F.coalesce("category_name", F.lit("")).alias("category"), F.array_join("tags", ",").alias("tags"), F.col("fetched_at").alias("created"), F.col("favorited").cast("string").alias("favourite"))
    return out.orderBy(F.desc("created"))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value).limit(1)


def lookup_all(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in a batch of keys."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def exists(df: DataFrame, column: str, value) -> bool:
    return bool(lookup(df, column, value).take(1))


@dataclass
class Page:
    rows: list[Row]
    has_more: bool
    cursor: tuple | None


def page_query(df: DataFrame, condition: ArticleFilter | None, limit: int, cursor: tuple | None = None, keys: tuple[str, ...] = ("fetched_at", "id")) -> DataFrame:
    """The page's rows and one more, in descending order of the keys."""
    if condition is not None:
        df = df.where(condition.column())
    if cursor is not None:
        df = df.where(before(cursor, *keys))
    return df.orderBy(*[F.desc(k) for k in keys]).limit(page_limit(limit) + 1)


def library_page(df: DataFrame, condition: ArticleFilter | None = None, limit: int = 60, cursor: tuple | None = None, keys: tuple[str, ...] = ("fetched_at", "id")) -> Page:
    rows = page_query(df, condition, limit, cursor, keys).collect()
    kept = rows[: page_limit(limit)]
    return Page(kept, len(rows) > len(kept), tuple(kept[-1][k] for k in keys) if kept else None)


def not_loaded(fresh: DataFrame, loaded: DataFrame, key: str = "id") -> DataFrame:
    return fresh.join(loaded, key, "left_anti")


def recent_of_source(articles: DataFrame, source_id: str, n: int) -> DataFrame:
    return articles.where(F.col("source_id") == source_id).orderBy(F.desc("fetched_at")).limit(n)


def recent_of_each(articles: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of every key at once."""
    ranked = articles.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def counts(articles: DataFrame) -> DataFrame:
    """Total, unread, favorites and uncategorized in one pass."""
    return articles.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reading_state") == "unread").alias("unread"), F.count_if("favorited").alias("favorited"), F.count_if(F.col("category_id").isNull()).alias("uncategorized"))


def tag_counts(articles: DataFrame, condition: ArticleFilter | None = None) -> DataFrame:
    """Articles by tag under the active filters."""
    if condition is not None:
        articles = articles.where(condition.column())
    return articles.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def by_name(df: DataFrame, column: str) -> DataFrame:
    """Without regard to ASCII case, the text itself breaking ties."""
    return df.orderBy(ascii_lower(column), column)


def category_counts(categories: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles by category, empty ones included; articles are counted before the join."""
    n = articles.where(F.col("category_id").isNotNull()).groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return categories.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_categories(counted: DataFrame, n: int = 5) -> DataFrame:
    return counted.orderBy(F.desc("n"), ascii_lower("name"), "name").limit(n)


def sidebar_categories(counted: DataFrame, articles: DataFrame, n: int = 5) -> DataFrame:
    """What the sidebar lists, by place: articles without a category first, under their pinned entry, then the top categories."""
    none = articles.where(F.col("category_id").isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit(UNCATEGORIZED).alias("id"), F.lit(UNCATEGORIZED_NAME).alias("name"), "n", F.lit(0).alias("place"))
    order = [F.desc("n"), ascii_lower("name"), F.col("name")]
    top = top_categories(counted, n).select("id", "name", "n", F.row_number().over(Window.orderBy(*order)).alias("place"))  # n rows
    return none.unionByName(top)


def facet_tags(counted: DataFrame, selected: tuple[str, ...] = (), narrowed: bool = False, n: int = 7) -> DataFrame:
    """Tags to narrow by: not the selected ones; by count where a filter is active, else by name."""
    rest = counted.where(~F.col("tag").isin(*selected)) if selected else counted
    order = [F.desc("n"), ascii_lower("tag"), "tag"] if narrowed or selected else [ascii_lower("tag"), "tag"]
    return rest.orderBy(*order).limit(n)


def suggest_tags(counted: DataFrame, present: tuple[str, ...], draft: str, n: int = 8) -> DataFrame:
    rest = counted.where(F.contains(F.lower("tag"), F.lit(draft.strip().lower())))
    if present:
        rest = rest.where(~F.col("tag").isin(*present))
    return rest.orderBy(ascii_lower("tag"), "tag").limit(n)


def sources_by_age(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("created_at"))


DEFAULT_SETTINGS = {
    "default_font_size": "medium", "default_library_view": "list", "autosync": "false", "reader_font_size": "18", "reader_measure": "medium",
    "reader_leading": "normal", "reader_font": "serif", "app_theme": "system", "import_concurrency": "5", "autosync_interval_hours": "6",
}


def settings_record(settings: DataFrame, defaults: dict[str, str] = DEFAULT_SETTINGS) -> DataFrame:
    """Key-value rows as one typed record; numbers that do not parse fall back."""
    row = settings.groupBy().pivot("key", list(defaults)).agg(F.first("value"))
    text = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()}
    number = lambda k: F.coalesce(F.expr(f"try_cast({k} AS BIGINT)"), F.lit(int(defaults[k])))
    typed = {
        "autosync": text["autosync"] == "true",
        "reader_font_size": number("reader_font_size"),
        "import_concurrency": clamp(number("import_concurrency"), 5, 10).cast("long"),
        "autosync_interval_hours": nearest(number("autosync_interval_hours")).cast("long"),
    }
    return row.select([typed.get(k, c).alias(k) for k, c in text.items()])
