"""Entities of the library as Spark schemas.

Timestamps are kept as the strings they arrived as, since some orders are lexical; typed columns are derived
where instants are compared (functions.text.instant).
"""

from __future__ import annotations

_OVERRIDES = "font_size_override bigint, measure_override string, leading_override string, theme_override string, font_override string"

ARTICLES = (
    "id string, source_id string, source_type string, title string, link string, excerpt string, content_html string, "
    "hero_image_path string, published_at string, fetched_at string, read_time_min bigint, reading_state string, "
    "favorited boolean, extraction_confident boolean, reading_progress double, tags array<string>, category_id string, "
    f"{_OVERRIDES}, updated_at string, capture_failed boolean, capture_error string"
)
CATEGORIES = "id string, name string, icon string, created_at string, updated_at string"
SOURCES = (
    "id string, name string, type string, feed_url string, status string, last_error string, article_count bigint, "
    "last_synced_at string, created_at string, updated_at string, feed_etag string, feed_last_modified string"
)
SETTINGS = "key string, value string"
TOMBSTONES = "entity_type string, entity_id string, deleted_at string"
MANIFEST = "id string, entity_type string, conflict_key string, updated_at string, created_at string, content_hash string"
LISTING = "key string, last_modified string"
LEDGER = "content_hash string, promoted boolean"

BOOKMARK_CSV = "title string, url string, folder string, tags string, created string, favorite string"
ARTICLE_CSV = "title string, url string, category string, tags string, created string, favourite string"
FEED_CSV = "name string, feed_url string"

#: Columns of a library row: everything but the content.
SUMMARY = ("id", "source_id", "source_type", "title", "link", "excerpt", "hero_image_path", "published_at", "fetched_at", "read_time_min", "reading_state", "favorited", "extraction_confident", "reading_progress", "tags", "category_id", "capture_failed", "capture_error")

SOURCE_TYPES = ("rss", "direct")
READING_STATES = ("unread", "reading", "read")
ENTITY_TYPES = ("article", "category", "source")
UNCATEGORIZED = "__uncategorized__"
UNCATEGORIZED_NAME = "Uncategorized"
