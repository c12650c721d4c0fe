"""Feed sync as one job: what changed is read, parsed, captured and inserted; a feed that fails stops no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.urls import clean_link
from ..operators import dedup, mutate
from ..operators.filters import syncable_sources
from ..sources.shared import cut
from ..sources.tables import FEED_ENTRIES, feed_entries, parsed_feed
from .capture import capture, pages_of


def sync_feeds(articles: DataFrame, sources: DataFrame, fetched: DataFrame, pages: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New articles, new sources, and a row a visited source: id, added, error.

    fetched: (feed_url, status, body, etag, last_modified); pages: (url, html). Paused sources are not visited, and one that
    answers 304 has nothing new. An answer that is no feed, or none, becomes the source's error. Of each feed the first
    FEED_ENTRIES entries count; links stored already are dropped before any page is parsed; an entry whose page was not fetched, or
    cannot be read, becomes a row that says so, and so counts as seen. A feed's title names a source that had only its address.
    """
    due = sources.where(syncable_sources()).select(F.col("id").alias("source_id"), "feed_url")
    visited = due.join(dedup.first_per_key(fetched, "feed_url", ["status"]), "feed_url", "left").withColumn("_f", F.when(F.col("status") == 200, parsed_feed("body")))
    same = F.coalesce(F.col("status") == 304, F.lit(False))
    error = F.when(~same & F.col("_f").isNull(), F.when(F.col("status").isNull(), "no answer").when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))).otherwise("not a feed"))
    visited = cut(visited.withColumns({"same": same, "error": error}).drop("body"))  # feeds are parsed once
    entries = feed_entries(visited.where("_f is not null").select(F.col("source_id").alias("feed"), F.slice("_f.items", 1, FEED_ENTRIES).alias("items"))).withColumnRenamed("feed", "source_id")
    entries = entries.withColumn("link", F.coalesce(clean_link("link"), F.col("link")))
    fresh = cut(dedup.first_per_key(entries.join(articles.select("link"), "link", "left_anti"), "link", ["source_id", "place"]))
    page = pages_of(pages, fresh.select("link"))
    got = capture(fresh.join(page, fresh["link"] == page["_link"], "left").select(F.col("link").alias("url"), "html", "source_id", "tags"), now)
    values = {"id": F.substring(F.sha2("link", 256), 1, 32), "source_type": F.lit("rss"), "tags": X.normalize_tags("tags"), "favorited": F.lit(False), "reading_state": F.lit("unread"), "reading_progress": F.lit(0.0), "updated_at": F.lit(now)}
    rows = got.withColumns(values)
    rows = rows.select([F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in articles.dtypes])
    added = fresh.groupBy("source_id").agg(F.count(F.lit(1)).alias("_added"))
    told = visited.select(F.col("source_id").alias("id"), F.lit(True).alias("_visited"), "same", "error", F.col("_f.title").alias("_title"), *[F.col(c).alias(f"_{c}") for c in ("etag", "last_modified")])
    report = told.join(added.withColumnRenamed("source_id", "id"), "id", "left").select("id", F.coalesce("_added", F.lit(0)).alias("added"), "error")
    both = sources.join(told, "id", "left").join(added.withColumnRenamed("source_id", "id"), "id", "left")
    hit, good = F.coalesce("_visited", F.lit(False)), F.col("_visited") & F.col("error").isNull()
    new = {
        "status": F.when(good, "active").when(hit, "error").otherwise(F.col("status")),
        "last_error": F.when(hit, F.col("error")).otherwise(F.col("last_error")),
        "last_synced_at": F.when(good, now).otherwise(F.col("last_synced_at")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "article_count": F.col("article_count") + F.coalesce("_added", F.lit(0)),
        "name": F.when(good & (F.col("name") == F.col("feed_url")) & (F.trim("_title") != ""), F.trim("_title")).otherwise(F.col("name")),
        "feed_etag": F.when(good & ~F.col("same"), F.col("_etag")).otherwise(F.col("feed_etag")),
        "feed_last_modified": F.when(good & ~F.col("same"), F.col("_last_modified")).otherwise(F.col("feed_last_modified")),
    }
    return mutate.insert_ignore(articles, rows), both.withColumns({c: v for c, v in new.items() if c in sources.columns}).select(*sources.columns), report


def first_entries(rows: DataFrame, key: str, order: str, n: int = FEED_ENTRIES) -> DataFrame:
    """The first n rows of each key with their place; no key's rows are gathered, as Spark cuts its groups before the exchange."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("place") <= n)
