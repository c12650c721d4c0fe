"""Scalar functions on text, times, tags and keys, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space as Unicode defines it, and control characters (categories Zs, Zl, Zp, and Cc).
_SPACE = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_CONTROL = r"[\u0000-\u001F\u007F-\u009F]"

EXCERPT_CHARS = 200
TITLE_CHARS = 300
WORDS_A_MINUTE = 200


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else, as the NOCASE collation compares."""
    return F.translate(_col(c), _UPPER, _LOWER)


def trim_space(c: Column | str) -> Column:
    """Without Unicode white space at both ends (F.trim takes off U+0020 only)."""
    return F.regexp_replace(_col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def collapse_space(c: Column | str) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(_col(c), f"{_SPACE}+", " "))


def contains_ascii_ci(c: Column | str, needle: str) -> Column:
    """Substring test without regard to ASCII case; % and _ are ordinary characters."""
    return F.contains(ascii_lower(c), ascii_lower(F.lit(needle)))


def contains_unicode_ci(c: Column | str, needle: str) -> Column:
    return F.contains(F.lower(_col(c)), F.lower(F.lit(needle)))


# documents


def tag_text(html: Column | str, tag: str) -> Column:
    """Trimmed text between the first <tag ...> and the next </tag>; null if there is none. Case-sensitive. Looked for one after
    the other, so that a page takes time in proportion to its length."""
    html = _col(html)
    start = F.locate(f"<{tag}", html)
    begin = F.position(F.lit(">"), html, start)
    close = F.position(F.lit(f"</{tag}>"), html, begin)
    return F.when((start > 0) & (begin > 0) & (close > 0), trim_space(F.substr(html, begin + 1, close - begin - 1)))


def strip_tags(html: Column | str) -> Column:
    """Text outside of <...>; an unclosed < runs to the end, and a stray > is dropped."""
    return F.regexp_replace(_col(html), r"(?s)<[^>]*(>|$)|>", "")


def excerpt(text: Column | str, chars: int = EXCERPT_CHARS) -> Column:
    flat = collapse_space(text)  # stands where it is always evaluated, so that it is evaluated once
    return F.concat(F.rtrim(F.substring(flat, 1, chars)), F.when(F.length(flat) > chars, "…").otherwise(""))


def word_count(text: Column | str) -> Column:
    flat = collapse_space(text)
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def read_time(text: Column | str) -> Column:
    """Whole minutes of reading, one at least."""
    return F.greatest(F.lit(1), F.floor(word_count(text) / WORDS_A_MINUTE)).cast("long")


def clean_title(c: Column | str) -> Column:
    """Null if the text was decoded wrongly; controls become spaces, spaces collapse, at most TITLE_CHARS."""
    c = _col(c)
    flat = collapse_space(F.regexp_replace(c, _CONTROL, " "))
    return F.when(~F.contains(c, F.lit("\ufffd")), F.substring(flat, 1, TITLE_CHARS))


def page_title(html: Column | str) -> Column:
    return F.coalesce(clean_title(tag_text(html, "title")), F.lit("Untitled"))


# tags


def parse_tags(c: Column | str) -> Column:
    """JSON list of strings; an empty list for anything else."""
    return F.coalesce(F.from_json(_col(c), "array<string>"), F.array().cast("array<string>"))


def tags_json(c: Column | str) -> Column:
    return F.to_json(_col(c))


def normalize_tags(tags: Column | str) -> Column:
    """Trimmed, lower case, without empty ones, each once in the order of first use."""
    return F.array_distinct(F.filter(F.transform(_col(tags), lambda t: F.lower(trim_space(t))), lambda t: t != ""))


def normalize_tags_sorted(tags: Column | str) -> Column:
    """The same for rows of the old form: ASCII case, spaces only, in alphabetical order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_col(tags), lambda t: ascii_lower(F.trim(t))), lambda t: t != "")))


def split_tags(cell: Column | str) -> Column:
    """Tags of a CSV cell: split at commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_col(cell), F.lit("")), ","), trim_space), lambda t: t != "")


def merge_tags(old: Column | str, new: Column | str) -> Column:
    """The old tags, then new ones that are not among them."""
    return F.array_union(_col(old), _col(new))


def rename_in_tags(tags: Column | str, old: str, new: str) -> Column:
    return F.array_distinct(F.transform(_col(tags), lambda t: F.when(t == old, F.lit(new)).otherwise(t)))


# folders and flags


def folder_name(cell: Column | str, uncategorized: str = "Uncategorized") -> Column:
    """Name shown for a CSV folder; blank and "unsorted" are the uncategorized one."""
    flat = trim_space(F.coalesce(_col(cell), F.lit("")))
    return F.when((flat == "") | (ascii_lower(flat) == "unsorted"), F.lit(uncategorized)).otherwise(flat)


def folder_key(cell: Column | str) -> Column:
    """Key by which folders are grouped; null for the uncategorized one."""
    flat = trim_space(F.coalesce(_col(cell), F.lit("")))
    return F.when((flat != "") & (ascii_lower(flat) != "unsorted"), flat)


def category_key(cell: Column | str) -> Column:
    """The same for the library's own CSV, where only blank means uncategorized."""
    flat = trim_space(F.coalesce(_col(cell), F.lit("")))
    return F.when(flat != "", flat)


def flag(cell: Column | str) -> Column:
    return ascii_lower(trim_space(F.coalesce(_col(cell), F.lit("")))) == "true"


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), _col(c)))


def nearest(c: Column | str, allowed: tuple[int, ...] = (6, 12, 24)) -> Column:
    """The allowed value nearest to c; the lower one on a tie."""
    c = _col(c)
    return F.array_min(F.transform(F.array(*[F.lit(a) for a in allowed]), lambda a: F.struct(F.abs(a - c).alias("gap"), a.alias("value"))))["value"]


def reading_state(unread: Column | str, progress: Column | str) -> Column:
    """State of rows from before there were states."""
    return F.when(_col(unread), "unread").when(_col(progress) == 0, "read").otherwise("reading")


# hashes and keys


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def blob_key(entity: Column | str, entity_id: Column | str, root: str = "sync") -> Column:
    plural = F.when(_col(entity) == "category", "categories").otherwise(F.concat(_col(entity), F.lit("s")))
    return F.concat(F.lit(f"{root}/blobs/"), plural, F.lit("/"), _col(entity_id), F.lit("/meta.json.gz"))


def images_key(article_id: Column | str, root: str = "sync") -> Column:
    return F.concat(F.lit(f"{root}/blobs/articles/"), _col(article_id), F.lit("/content.tar.gz"))


def shared_image_key(digest: Column | str, root: str = "sync") -> Column:
    return F.concat(F.lit(f"{root}/blobs/shared-images/"), _col(digest))


# times


def instant(c: Column | str) -> Column:
    """Timestamp of an RFC 3339 string, to the microsecond; null if it is not one."""
    c = _col(c)
    return F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")), F.try_to_timestamp(F.upper(c)))


def sync_order(c: Column | str) -> Column:
    """What sync compares: the instant and the nanoseconds below a microsecond; the least possible if unparseable."""
    c = _col(c)
    below = F.rpad(F.regexp_extract(c, r"\.\d{6}(\d{1,3})", 1), 3, "0").cast("int")
    at = F.unix_micros(instant(c))
    return F.struct(F.coalesce(at, F.lit(-(1 << 63))).alias("micros"), F.coalesce(F.when(at.isNotNull(), below), F.lit(0)).alias("nanos"))


def relative_time(c: Column | str, now: Column) -> Column:
    """How long ago, in words."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(instant(c))) / 60e6 + 0.5).cast("long")
    hours = F.floor(minutes / 60.0 + 0.5).cast("long")
    days = F.floor(hours / 24.0 + 0.5).cast("long")
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(minutes.isNull(), "never")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, many(hours, "hour"))
        .otherwise(many(days, "day"))
    )


def compact_time(c: Column | str, now: Column) -> Column:
    """The same in few characters; a date beyond a week, empty if unparseable."""
    at = instant(c)
    minutes = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60e6 + 0.5)).cast("long")
    hours = F.floor(minutes / 60.0 + 0.5).cast("long")
    days = F.floor(hours / 24.0 + 0.5).cast("long")
    return (
        F.when(at.isNull(), "")
        .when(minutes < 1, "now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(at, "MMM d"))
    )


# captures

#: Media types by file extension.
MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif",
    "svg": "image/svg+xml", "bmp": "image/bmp", "ico": "image/x-icon", "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime",
}


def media_type(path: Column | str) -> Column:
    extension = ascii_lower(F.element_at(F.split(_col(path), r"\."), -1))
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit("application/octet-stream"))


def is_transient(kind: Column | str, status: Column | str) -> Column:
    """Whether a failed capture may succeed later: no answer at all, a server's error, 408 or 429."""
    return F.coalesce((_col(kind) == "transport") | ((_col(kind) == "status") & (_col(status).between(500, 599) | _col(status).isin(408, 429))), F.lit(False))
