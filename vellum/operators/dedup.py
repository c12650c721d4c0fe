"""Keeping one of many: newest rows, conflict winners, merged state, content hashes and seen-sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sync_order

def newest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns of each key, as one aggregation with map-side combining."""
    rest = [c for c in df.columns if c not in order]
    best = df.groupBy([F.col(k).alias(f"_{k}") for k in key]).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select([F.col("_best")[c].alias(c) for c in df.columns])


def first_per_key(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row a key: the least by the order columns (id, if there is one and none are named), then by the others, so that
    the same rows give the same result however they are dealt."""
    order = ["id"] if order is None and "id" in df.columns else order or []
    rest = [c for c in df.columns if c not in order and c != key]
    least = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.lit(0).alias("_0"), *order, *rest)).alias("_first"))
    return least.select([F.col("_key").alias(key) if c == key and c not in order else F.col("_first")[c].alias(c) for c in df.columns])


def _named(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key: a missing or empty one collides with nothing."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != ""))


def conflict_winners(df: DataFrame, key: str = "conflict_key") -> DataFrame:
    """Earliest created row of each key, smaller id on a tie: the same on every replica."""
    return _named(df, key).groupBy(key).agg(F.min(F.struct("created_at", "id")).alias("_w"), F.count(F.lit(1)).alias("n")).select(key, F.col("_w.id").alias("winner_id"), "n")


def conflict_losers(df: DataFrame, key: str = "conflict_key") -> DataFrame:
    """(id, winner_id) of all other rows."""
    return df.select("id", key).join(conflict_winners(df, key).where("n > 1"), key).where("id <> winner_id").select("id", "winner_id")


def merged_state(df: DataFrame, key: str = "conflict_key") -> DataFrame:
    """Winner of each key with the state of its whole group: union of tags, furthest progress, any favorite.

    Tags are made distinct before they are gathered, so a group costs its distinct tags.
    """
    rows = df.groupBy(key).agg(F.min(F.struct("created_at", "id")).alias("_w"), F.max("reading_progress").alias("reading_progress"), F.bool_or("favorited").alias("favorited"))
    return _with_tags(rows, df, key).select(key, F.col("_w.id").alias("winner_id"), "tags", "reading_progress", "favorited")


def conflict_groups(df: DataFrame, key: str = "conflict_key") -> DataFrame:
    """The same for the keys that several rows share, from one aggregation of all rows and one of those rows' tags."""
    rows = _named(df, key).groupBy(key).agg(F.min(F.struct("created_at", "id")).alias("_w"), F.count(F.lit(1)).alias("_n"), F.max("reading_progress").alias("reading_progress"), F.bool_or("favorited").alias("favorited")).where("_n > 1")
    return _with_tags(rows, df.join(rows.select(key), key, "left_semi"), key).select(key, F.col("_w.id").alias("winner_id"), "tags", "reading_progress", "favorited")


def _with_tags(rows: DataFrame, df: DataFrame, key: str) -> DataFrame:
    tags = df.select(key, F.explode("tags").alias("_t")).groupBy(key).agg(F.array_sort(F.collect_set("_t")).alias("tags"))
    return rows.join(tags, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def collapse_sources(sources: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One source for each feed: the newest stays, counts add up, and articles of the others move to it. Sources without a
    feed stay as they are."""
    fed = sources.where("feed_url is not null")
    best = fed.groupBy("feed_url").agg(F.max(F.struct("created_at", "id")).alias("_b"), F.sum("article_count").alias("_sum"))
    kept = best.select(F.col("_b.id").alias("id"), F.col("_sum"))
    survivors = fed.join(kept, "id").withColumn("article_count", F.col("_sum")).select(*sources.columns).unionByName(sources.where("feed_url is null"))
    moves = fed.select("feed_url", F.col("id").alias("source_id")).join(best.select("feed_url", F.col("_b.id").alias("_to")), "feed_url").select("source_id", "_to").where("source_id <> _to")
    moved = articles.join(moves, "source_id", "left").withColumn("source_id", F.coalesce("_to", "source_id")).drop("_to")
    return survivors, moved.select(*articles.columns)


def source_counts(articles: DataFrame) -> DataFrame:
    """The counter kept with each source, computed anew."""
    return articles.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.count(F.lit(1)).alias("article_count"))


def one_path_per_content(assets: DataFrame, doc: str = "doc_id", data: str = "body", url: str = "url", path: str = "path") -> DataFrame:
    """Path of each asset of a document; equal contents share the path of the first URL."""
    keyed = assets.withColumn("_h", F.sha2(F.col(data).cast("binary"), 256))
    first = keyed.groupBy(doc, "_h").agg(F.min(F.struct(url, path)).alias("_f")).select(doc, "_h", F.col("_f")[path].alias("stored_path"))
    return keyed.join(first, [doc, "_h"]).select(doc, url, F.col("_h").alias("content_hash"), "stored_path")


def sightings(entries: DataFrame, ledger: DataFrame, order: list[Column | str], key: str = "content_hash") -> DataFrame:
    """What to do with each entry: the first sighting of a content is stored literally, the second promotes it
    to a shared blob, all later ones point there. The ledger says what earlier passes have seen.

    Only the first two entries of a content differ from the rest, so they are found by aggregation, and no
    content's entries need to meet in one task.
    """
    order_key = F.struct(*order)
    keyed = entries.withColumn("_o", order_key)
    first = keyed.groupBy(key).agg(F.min("_o").alias("_first"))
    second = keyed.join(first, key).where(F.col("_o") > F.col("_first")).groupBy(key).agg(F.min("_o").alias("_second"))
    known = ledger.select(key, F.col("promoted").alias("_promoted"))
    rows = keyed.join(first, key).join(second, key, "left").join(known, key, "left")
    is_first, is_second = F.col("_o") == F.col("_first"), F.col("_o") == F.col("_second")
    action = (
        F.when(F.col("_promoted"), "pointer")
        .when(F.col("_promoted").isNotNull(), F.when(is_first, "promote").otherwise("pointer"))
        .when(is_first, "literal")
        .when(is_second, "promote")
        .otherwise("pointer")
    )
    return rows.withColumn("action", action).drop("_o", "_first", "_second", "_promoted")


def updated_ledger(entries: DataFrame, ledger: DataFrame, key: str = "content_hash") -> DataFrame:
    seen = entries.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = ledger.join(seen, key, "full_outer")
    return both.select(key, (F.coalesce("promoted", F.lit(False)) | (F.coalesce("_n", F.lit(0)) + F.col("promoted").isNotNull().cast("int") >= 2)).alias("promoted"))


def earliest_tombstones(tombstones: DataFrame) -> DataFrame:
    """The earliest instant of each deletion, whatever its zone; times that do not parse come before all others."""
    least = F.min(F.struct(sync_order("deleted_at").alias("at"), F.col("deleted_at").alias("text")))
    return tombstones.groupBy("entity_type", "entity_id").agg(least.alias("_l")).select("entity_type", "entity_id", F.col("_l.text").alias("deleted_at"))


def new_and_known(batch: DataFrame, stored: DataFrame, key: str, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """First row of each key that is not stored, and how the batch's rows fared (added, skipped)."""
    fresh = first_per_key(batch, key, order).join(stored.select(key), key, "left_anti")
    known = batch.join(stored.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    added = F.count_distinct(F.when(F.col("_known").isNull(), F.col(key)))
    return fresh, known.agg(added.alias("added"), (F.count(F.lit(1)) - added).alias("skipped"))


def first_n(items: Column | str, n: int = 30) -> Column:
    return F.slice(items, 1, n)


def rank_in_key(df: DataFrame, key: str, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
