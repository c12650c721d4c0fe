"""The library's changes against a store that keeps articles in buckets of their link.

Each edit names the links it touches, so it reads and writes their buckets alone. Edits by id or by tag look the links up first,
in a scan of those columns. Deletions change articles, counters and tombstones in one version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters, mutate
from ..schemas import ARTICLES, CATEGORIES, SOURCES, TOMBSTONES
from ..sources.shared import cut
from ..sources.store import BUCKETS, Store

KEYS = {"articles": "link", "tombstones": "entity_id"}


def open_library(spark: SparkSession, path: str, buckets: int = BUCKETS, articles: str = ARTICLES, sources: str = SOURCES, more: Mapping[str, str] | None = None) -> Store:
    """more: further tables without a key."""
    return Store(spark, path, {"articles": articles, "categories": CATEGORIES, "sources": sources, "tombstones": TOMBSTONES, **(more or {})}, KEYS, buckets)


def open_counted(spark: SparkSession, path: str, buckets: int = BUCKETS, articles: str = ARTICLES, sources: str = SOURCES) -> Store:
    """A library that keeps its counters by deltas."""
    schemas = {"articles": articles, "categories": CATEGORIES, "sources": sources, "tombstones": TOMBSTONES, "deltas": counters.DELTAS}
    return Store(spark, path, schemas, {**KEYS, "deltas": "batch"}, buckets)


def links_where(store: Store, condition: Column) -> DataFrame:
    """Links of the stored articles that a condition holds for."""
    return store.read()["articles"].where(condition).select("link")


def links_of(store: Store, ids: DataFrame) -> DataFrame:
    return store.read()["articles"].select("id", "link").join(ids.select("id").distinct(), "id", "left_semi").select("link")


def edit(store: Store, links: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Apply a change of articles (operators.mutate) to the buckets of some links; counters go along if the store keeps them."""
    if "deltas" in store.keys:
        return counters.counted_change(store, links, change)
    return store.change({"articles": links}, lambda state: {"articles": change(state["articles"])})


def edit_where(store: Store, condition: Column, change: Callable[[DataFrame], DataFrame]) -> int:
    return edit(store, links_where(store, condition), change)


def insert(store: Store, batch: DataFrame, order: list[str] | None = None) -> int:
    """Insert the first row of each link, unless the link is stored."""
    rows = cut(batch)
    return edit(store, rows, lambda articles: mutate.insert_ignore(articles, rows, "link", order))


def import_rows(store: Store, batch: DataFrame, now: str, order: list[str] | None = None) -> int:
    """Insert new links; stored ones get the tags."""
    rows = cut(batch)
    return edit(store, rows, lambda articles: mutate.import_rows(articles, rows, now, order))


def rename_tag(store: Store, old: str, new: str, now: str) -> int:
    return edit_where(store, F.array_contains("tags", mutate.folded_tag(old)), lambda articles: mutate.rename_tag(articles, old, new, now))


def delete_tag(store: Store, tag: str, now: str) -> int:
    return edit_where(store, F.array_contains("tags", mutate.folded_tag(tag)), lambda articles: mutate.delete_tag(articles, tag, now))


def apply_state_log(store: Store, log: DataFrame) -> int:
    """A batch of reader events by id."""
    events = cut(log)
    return edit(store, links_of(store, events), lambda articles: mutate.apply_state_log(articles, events))


def delete(store: Store, ids: DataFrame, now: str) -> int:
    """Articles go, their sources count fewer, tombstones stay: one version."""
    gone = cut(ids.select("id").distinct())
    batch = uuid.uuid4().hex
    keys = {"articles": links_of(store, gone), "tombstones": gone.select(F.col("id").alias("entity_id"))}
    if "deltas" in store.keys:
        keys["deltas"] = store.spark.createDataFrame([(batch,)], "batch string")

    def change(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        articles, sources, tombstones = mutate.delete_articles(state["articles"], state["sources"], state["tombstones"], gone, now)
        new = {"articles": articles, "sources": sources, "tombstones": tombstones}
        if "deltas" in state:
            new["deltas"] = state["deltas"].unionByName(counters.deltas(state["articles"], articles, batch))
        return new

    return store.change(keys, change, reads=("sources",))
