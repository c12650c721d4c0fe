"""Changes to the library as functions from state to state; the snapshot store commits them.

A change of one row and a batch of changes are the same function: the arguments are columns or small frames.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, clamp, merge_tags, nearest, normalize_tags, rename_in_tags
from ..schemas import SETTINGS
from .dedup import first_per_key

#: Columns that a new capture of a page replaces; reading state, tags and the like stay.
CONTENT = ("title", "excerpt", "content_html", "hero_image_path", "published_at", "read_time_min", "extraction_confident", "capture_failed", "capture_error")
OVERRIDES = ("font_size_override", "measure_override", "leading_override", "theme_override", "font_override")


def change(df: DataFrame, condition: Column, values: Mapping[str, Column | object]) -> DataFrame:
    """UPDATE: new values where the condition is true."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    types = dict(df.dtypes)
    return df.withColumns({c: F.when(condition, lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})


def upsert(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch replace rows of equal keys."""
    return state.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def insert_ignore(state: DataFrame, batch: DataFrame, key: str = "link", order: list[str] | None = None) -> DataFrame:
    """New rows, the first of each key in the batch by the order columns (see first_per_key), unless the key is stored."""
    return state.unionByName(first_per_key(batch, key, order).join(state.select(key), key, "left_anti").select(*state.columns))


def insert_and_return(state: DataFrame, batch: DataFrame, key: str = "link", order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """New state, and the stored row for each key of the batch, whether it was there or not."""
    after = insert_ignore(state, batch, key, order)
    return after, after.join(batch.select(key).distinct(), key, "left_semi")


def top_up_tags(state: DataFrame, batch: DataFrame, now: str, key: str = "link") -> DataFrame:
    """Append tags by link, folded as stored ones are; rows that gain none keep their time of change."""
    new = batch.select(key, F.posexplode(normalize_tags("tags")).alias("_i", "_t")).groupBy(key, "_t").agg(F.min("_i").alias("_i"))
    new = new.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"]).alias("_new"))
    joined = state.join(new, key, "left")
    merged = merge_tags("tags", F.coalesce("_new", F.array().cast("array<string>")))
    grew = F.size(merged) > F.size(F.array_distinct("tags"))
    return joined.withColumns({"tags": F.when(grew, merged).otherwise(F.col("tags")), "updated_at": F.when(grew, F.lit(now)).otherwise(F.col("updated_at"))}).select(*state.columns)


def import_rows(state: DataFrame, batch: DataFrame, now: str, order: list[str] | None = None) -> DataFrame:
    """New links are inserted; links already there get the tags only."""
    return insert_ignore(top_up_tags(state, batch, now), batch, "link", order)


def recapture(state: DataFrame, batch: DataFrame, now: str, key: str = "id") -> DataFrame:
    """New content under the same id."""
    new = batch.select(key, F.struct(*CONTENT).alias("_new"))
    joined = state.join(new, key, "left")
    hit = F.col("_new").isNotNull()
    values = {c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)) for c in CONTENT}
    return joined.withColumns(values | {"updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}).select(*state.columns)


def folded_tag(name: str) -> str:
    """A name as tags are stored: trimmed, in lower case."""
    return name.strip().lower()


def tagged(state: DataFrame, tag: str) -> int:
    """How many articles a change of the tag touches."""
    return state.where(F.array_contains("tags", folded_tag(tag))).count()


def rename_tag(state: DataFrame, old: str, new: str, now: str) -> DataFrame:
    """Rename on every article; where the new name is there already, the two become one. Names are folded as tags are; to
    an equal or an empty name there is nothing to do."""
    old, new = folded_tag(old), folded_tag(new)
    if not old or not new or old == new:
        return state
    return change(state, F.array_contains("tags", old), {"tags": rename_in_tags("tags", old, new), "updated_at": now})


def delete_tag(state: DataFrame, tag: str, now: str) -> DataFrame:
    tag = folded_tag(tag)
    return change(state, F.array_contains("tags", tag), {"tags": F.array_remove("tags", tag), "updated_at": now})


def set_tags(state: DataFrame, article_id: str, tags: list[str], now: str) -> DataFrame:
    return change(state, F.col("id") == article_id, {"tags": normalize_tags(F.array(*[F.lit(t) for t in tags]).cast("array<string>")), "updated_at": now})


# categories


class NameTaken(ValueError):
    """Another category has the name, up to ASCII case."""


def _same_name(name: str) -> Column:
    return ascii_lower("name") == ascii_lower(F.lit(name.strip()))


def find_category(categories: DataFrame, name: str) -> DataFrame:
    return categories.where(_same_name(name)).limit(1)


def create_category(categories: DataFrame, category_id: str, name: str, now: str, icon: str = "folder") -> DataFrame:
    if find_category(categories, name).take(1):
        raise NameTaken(name)
    row = categories.sparkSession.createDataFrame([(category_id, name.strip(), icon, now, now)], "id string, name string, icon string, created_at string, updated_at string")
    return categories.unionByName(row)


def find_or_create_categories(categories: DataFrame, names: DataFrame, now: str) -> DataFrame:
    """Categories with one more for each name of the batch that has none; ids follow from the names."""
    new = names.select(F.col("name"), ascii_lower("name").alias("_k")).groupBy("_k").agg(F.min("name").alias("name"))
    new = new.join(categories.select(ascii_lower("name").alias("_k")), "_k", "left_anti")
    made = new.select(F.substring(F.sha2("_k", 256), 1, 32).alias("id"), "name", F.lit("folder").alias("icon"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return categories.unionByName(made)


def rename_category(categories: DataFrame, category_id: str, name: str, now: str) -> DataFrame:
    if categories.where(_same_name(name) & (F.col("id") != category_id)).take(1):
        raise NameTaken(name)
    return change(categories, F.col("id") == category_id, {"name": name.strip(), "updated_at": now})


def set_icon(categories: DataFrame, category_id: str, icon: str, now: str) -> DataFrame:
    return change(categories, F.col("id") == category_id, {"icon": icon, "updated_at": now})


def tombstone(df: DataFrame, entity_type: str, at: str, ids: DataFrame) -> DataFrame:
    """Tombstones with one for each id; a later deletion refreshes the time."""
    new = ids.select(F.lit(entity_type).alias("entity_type"), F.col("id").alias("entity_id"), F.lit(at).alias("deleted_at")).distinct()
    return upsert(df, new, ["entity_type", "entity_id"])


def record_remote_tombstones(df: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote deletions keep the time they happened at."""
    return upsert(df, remote.select("entity_type", "entity_id", "deleted_at"), ["entity_type", "entity_id"])


def delete_category(categories: DataFrame, articles: DataFrame, tombstones: DataFrame, category_id: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Its articles become uncategorized."""
    gone = categories.where(F.col("id") == category_id)
    return categories.where(F.col("id") != category_id), change(articles, F.col("category_id") == category_id, {"category_id": None, "updated_at": now}), tombstone(tombstones, "category", now, gone)


def assign_category(articles: DataFrame, categories: DataFrame, article_id: str, category_id: str | None, now: str) -> DataFrame:
    if category_id is not None and not categories.where(F.col("id") == category_id).take(1):
        raise ValueError(f"no category {category_id}")
    return change(articles, F.col("id") == article_id, {"category_id": category_id, "updated_at": now})


# articles


def delete_articles(articles: DataFrame, sources: DataFrame, tombstones: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the ids; the sources' counters go down, not below zero, which is a change of theirs."""
    gone = articles.join(ids.select("id").distinct(), "id", "left_semi")
    lost = gone.where("source_id is not null").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("_lost"))
    left = F.greatest(F.lit(0), F.col("article_count") - F.coalesce("_lost", F.lit(0)))
    fewer = sources.join(lost, "id", "left").withColumns({"article_count": left} | _touched(sources, F.col("_lost").isNotNull(), now)).select(*sources.columns)
    return articles.join(ids.select("id"), "id", "left_anti"), fewer, tombstone(tombstones, "article", now, gone)


def _touched(rows: DataFrame, condition: Column, now: str) -> dict[str, Column]:
    return {"updated_at": F.when(condition, F.lit(now)).otherwise(F.col("updated_at"))} if "updated_at" in rows.columns else {}


def delete_all_articles(articles: DataFrame, sources: DataFrame, tombstones: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    none = sources.withColumns({"article_count": F.lit(0).cast("long")} | _touched(sources, F.lit(True), now))
    return articles.limit(0), none.select(*sources.columns), tombstone(tombstones, "article", now, articles)


def apply_state_log(articles: DataFrame, log: DataFrame) -> DataFrame:
    """A batch of reader events (id, at, and any of reading_state, favorited, reading_progress): the last value of each counts."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    values = log.groupBy("id").agg(*[last(c).alias(f"_{c}") for c in ("reading_state", "favorited", "reading_progress")], F.max("at").alias("_at"))
    joined = articles.join(values, "id", "left")
    new = {c: F.coalesce(f"_{c}", c) for c in ("reading_state", "favorited")}
    new["reading_progress"] = F.coalesce(clamp("_reading_progress", 0.0, 1.0), F.col("reading_progress"))
    return joined.withColumns(new | {"updated_at": F.coalesce("_at", "updated_at")}).select(*articles.columns)


def open_article(articles: DataFrame, article_id: str, now: str) -> DataFrame:
    """Unread articles turn into ones being read."""
    return change(articles, (F.col("id") == article_id) & (F.col("reading_state") == "unread"), {"reading_state": "reading", "updated_at": now})


def toggle_favorite(articles: DataFrame, article_id: str, now: str) -> DataFrame:
    return change(articles, F.col("id") == article_id, {"favorited": ~F.col("favorited"), "updated_at": now})


def save_progress(articles: DataFrame, article_id: str, progress: float, now: str) -> DataFrame:
    return change(articles, F.col("id") == article_id, {"reading_progress": clamp(F.lit(progress), 0.0, 1.0), "updated_at": now})


def set_overrides(articles: DataFrame, article_id: str, overrides: Mapping[str, object]) -> DataFrame:
    """All five at once; the time of change stays, so overrides alone do not sync."""
    return change(articles, F.col("id") == article_id, {c: overrides.get(c) for c in OVERRIDES})


# sources


def insert_source(sources: DataFrame, source: DataFrame) -> DataFrame:
    return insert_ignore(sources, source, "feed_url")


def toggle_pause(sources: DataFrame, source_id: str, now: str) -> DataFrame:
    return change(sources, F.col("id") == source_id, {"status": F.when(F.col("status") == "paused", "active").otherwise("paused"), "updated_at": now})


def mark_synced(sources: DataFrame, source_id: str, now: str) -> DataFrame:
    return change(sources, F.col("id") == source_id, {"status": "active", "last_error": None, "last_synced_at": now, "updated_at": now})


def mark_error(sources: DataFrame, source_id: str, error: str, now: str) -> DataFrame:
    return change(sources, F.col("id") == source_id, {"status": "error", "last_error": error, "updated_at": now})


def name_if_default(sources: DataFrame, source_id: str, name: str) -> DataFrame:
    """A feed's own title, where the name is still its address."""
    return change(sources, (F.col("id") == source_id) & (F.col("name") == F.col("feed_url")), {"name": name})


def set_feed_cache(sources: DataFrame, source_id: str, etag: str | None, last_modified: str | None) -> DataFrame:
    return change(sources, F.col("id") == source_id, {"feed_etag": etag, "feed_last_modified": last_modified})


def remove_source(sources: DataFrame, articles: DataFrame, tombstones: DataFrame, source_id: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Its articles stay, without a source."""
    gone = sources.where(F.col("id") == source_id)
    return sources.where(F.col("id") != source_id), change(articles, F.col("source_id") == source_id, {"source_id": None}), tombstone(tombstones, "source", now, gone)


def update_settings(settings: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Keyed overwrite; bounded numbers are brought into range as they are stored."""
    spark = settings.sparkSession
    rows = [(k, ("true" if v else "false") if isinstance(v, bool) else str(v)) for k, v in values.items()]
    batch = spark.createDataFrame(rows, SETTINGS)
    number = F.expr("try_cast(value AS BIGINT)")
    kept = F.when(F.col("key") == "import_concurrency", clamp(number, 5, 10).cast("string")).when(F.col("key") == "autosync_interval_hours", nearest(number).cast("string")).otherwise(F.col("value"))
    return upsert(settings, batch.withColumn("value", F.coalesce(kept, "value")), ["key"])


# sync


def upsert_synced(state: DataFrame, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole rows by id; `keep` names columns whose local value stays (a source's counter)."""
    if not keep:
        return upsert(state, rows.select(*state.columns), ["id"])
    local = state.select("id", F.struct(*keep).alias("_local"))
    mixed = rows.join(local, "id", "left").withColumns({c: F.coalesce(F.col("_local")[c], F.col(c)) for c in keep})
    return upsert(state, mixed.select(*state.columns), ["id"])


def apply_tombstones(state: DataFrame, entity_type: str, tombstones: DataFrame) -> DataFrame:
    gone = tombstones.where(F.col("entity_type") == entity_type).select(F.col("entity_id").alias("id"))
    return state.join(gone, "id", "left_anti")


def replace_entries(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    return upsert(manifest, entries, ["entity_type", "id"])


