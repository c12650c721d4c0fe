"""CSV imports: preview, rows with their outcome, and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.urls import clean_link
from ..operators import dedup, mutate
from ..schemas import UNCATEGORIZED_NAME
from ..sources.shared import cut
from .capture import capture, pages_of


def import_links(rows: DataFrame, url: str = "url") -> DataFrame:
    """Rows with the link they would be stored under; null where the URL does not parse."""
    return rows.withColumn("link", clean_link(X.trim_space(url)))


def preview(rows: DataFrame, articles: DataFrame, folder: Column) -> DataFrame:
    """Rows and already stored ones by folder, uncategorized first, then by name."""
    stored = articles.select("link").distinct().withColumn("_dup", F.lit(True))
    keyed = import_links(rows).withColumn("_key", folder).join(stored, "link", "left")
    counted = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_dup")).alias("duplicates"))
    return counted.select(F.coalesce("_key", F.lit(UNCATEGORIZED_NAME)).alias("folder"), "rows", "duplicates", F.col("_key").isNotNull().alias("_named")).orderBy("_named", "folder").drop("_named")


def outcomes(rows: DataFrame, articles: DataFrame, captures: DataFrame, order: tuple[str, ...] = ("line",)) -> DataFrame:
    """What each row came to: failed (no link, or its capture failed), skipped (stored before, or another row of the link comes
    first by the order columns), imported. Equal rows of one place count as that many."""
    order = [c for c in order if c in rows.columns] or list(rows.columns)
    keyed = cut(import_links(rows).withColumn("_i", F.struct(*order)))  # links are cleaned once, and read by three plans
    first = keyed.where("link is not null").groupBy("link").agg(F.min("_i").alias("_first"))
    stored = articles.select("link").distinct().withColumn("_dup", F.lit(True))
    failed = captures.where("capture_failed").select("link").distinct().withColumn("_failed", F.lit(True))
    joined = keyed.join(first, "link", "left").join(stored, "link", "left").join(failed, "link", "left")
    outcome = F.when(F.col("link").isNull(), "failed").when(F.col("_dup") | (F.col("_i") > F.col("_first")), "skipped").when(F.col("_failed"), "failed").otherwise("imported")
    return joined.select(*rows.columns, "link", outcome.alias("outcome"))


def import_job(rows: DataFrame, articles: DataFrame, categories: DataFrame, pages: DataFrame, now: str, order: tuple[str, ...] = ("line",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bookmark file from rows to library: new articles and categories, and each row's outcome.

    pages: (url, html) of what was fetched. Folders that are no categories yet become some. Links that are new are captured;
    those without a page become rows that say so. Links already stored get the tags only.
    """
    folders = rows.select(X.folder_key("folder").alias("name")).where("name is not null").distinct()
    known = mutate.find_or_create_categories(categories, folders, now)
    fields = [c for c in order if c in rows.columns]
    batch = dedup.first_per_key(bookmark_articles(rows, known, fields).where("link is not null"), "link", fields or ["fetched_at", "title"])
    new = cut(batch.join(articles.select("link"), "link", "left_anti"))
    fetched = pages_of(pages, new.select("link"))
    captured = cut(capture(new.join(fetched, new["link"] == fetched["_link"], "left").select(F.col("link").alias("url"), "html", F.col("fetched_at").alias("_created")), now, published="_created"))  # pages are parsed once
    done = outcomes(rows, articles, captured.select("link", "capture_failed"), order)
    said = captured.select("link", *[F.col(c).alias(f"_{c}") for c in ("title", "excerpt", "content_html", "read_time_min", "capture_failed") if c in articles.columns])
    made = new.join(said, "link")
    values = {
        "id": F.substring(F.sha2("link", 256), 1, 32),
        "title": F.coalesce(F.nullif("title", F.lit("")), F.col("_title")),
        "source_type": F.lit("direct"),
        "reading_state": F.lit("unread"),
        "reading_progress": F.lit(0.0),
        "updated_at": F.lit(now),
    } | {c[1:]: F.col(c) for c in said.columns if c not in ("link", "_title")}
    made = made.withColumns(values)
    inserted = made.select([F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in articles.dtypes])
    return mutate.top_up_tags(articles, batch.select("link", "tags"), now).unionByName(inserted), known, done


def summary(done: DataFrame) -> DataFrame:
    n = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return done.agg(n("imported"), n("skipped"), n("failed"))


def bookmark_articles(rows: DataFrame, categories: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fields of imported bookmarks: tags, flag and time from the row, the category by folded name; and the columns to keep."""
    named = categories.select(X.ascii_lower("name").alias("_k"), F.col("id").alias("category_id"))
    keyed = import_links(rows).withColumn("_k", X.ascii_lower(X.folder_key("folder"))).join(named, "_k", "left")
    return keyed.select(*(keep or []), "link", F.col("title"), X.normalize_tags(X.split_tags("tags")).alias("tags"), X.flag("favorite").alias("favorited"), F.col("created").alias("fetched_at"), "category_id")
