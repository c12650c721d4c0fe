"""Sweeps: files and blobs that nothing refers to any more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blob_key, images_key
from .filters import past_grace


def referenced_files(articles: DataFrame) -> DataFrame:
    return articles.select("id", "hero_image_path")


def orphan_content(listing: DataFrame, articles: DataFrame) -> DataFrame:
    """Files under content/<id>/ whose article is gone."""
    keyed = listing.where(F.startswith("key", F.lit("content/"))).withColumn("id", F.element_at(F.split("key", "/"), 2))
    return keyed.join(articles.select("id"), "id", "left_anti").drop("id")


def orphan_media(listing: DataFrame, articles: DataFrame) -> DataFrame:
    """Images under media/ that no article shows."""
    live = articles.where("hero_image_path is not null").select(F.col("hero_image_path").alias("key")).distinct()
    return listing.where(F.startswith("key", F.lit("media/"))).join(live, "key", "left_anti")


def live_blob_keys(manifest: DataFrame, root: str = "sync") -> DataFrame:
    entries = manifest.select(blob_key("entity_type", "id", root).alias("key"))
    return entries.unionByName(manifest.where("entity_type = 'article'").select(images_key("id", root).alias("key"))).distinct()


def orphan_blobs(listing: DataFrame, manifest: DataFrame, now: Column, root: str = "sync") -> DataFrame:
    """Blobs past their grace that no entry needs; shared images always stay."""
    candidates = listing.where(F.startswith("key", F.lit(f"{root}/blobs/")) & ~F.startswith("key", F.lit(f"{root}/blobs/shared-images/")) & past_grace("last_modified", now))
    return candidates.join(live_blob_keys(manifest, root), "key", "left_anti")


def delete_batches(keys: DataFrame, size: int = 1000) -> DataFrame:
    """Keys in batches of at most about `size`, as an object store deletes them."""
    n = max(1, -(-keys.count() // size))
    return keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(n)).alias("batch")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
