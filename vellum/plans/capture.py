"""From fetched pages to library rows.

Links already stored are dropped before any page is parsed; native expressions do what they can, and one fused
UDF does the rest, so that a page crosses to Python once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions import text as X
from ..functions import urls
from ..functions.readable import Metadata, metadata, readable
from ..functions.urls import clean_link, link_host
from ..operators.dedup import first_per_key


_TEXTS = ("link", "final_url", "title", "excerpt", "published", "content_html", "text_html", "hero_url")
_CAPTURED = T.StructType([*(T.StructField(c, T.StringType()) for c in _TEXTS), T.StructField("confident", T.BooleanType()), T.StructField("assets", T.ArrayType(T.StringType()))])


@F.pandas_udf(_CAPTURED)
def captured(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    """Everything of a capture that native functions cannot do, in one crossing. text_html: what excerpt and reading time come from."""
    return pd.DataFrame([_captured(u, h or "") for u, h in zip(url, html, strict=True)], columns=_CAPTURED.names)


def _captured(url: str | None, html: str) -> tuple:
    base = urls.parse(url)
    content = readable(html)
    confident, title = content is not None, H.inner_text(html, "title")
    said = metadata(html) if confident else Metadata()
    if content is None:
        body = H.inner_text(html, "body")
        content, text = body or "", body
        clean = H.sanitize(content)
    else:
        text = clean = H.sanitize(content)
    assets = H.references(clean, base)
    hero = (urls.resolve(said.image, base) or next(iter(H.references(html, base)), None)) if confident else None
    return urls.clean(url), str(base) if base else None, said.title or title, said.excerpt, said.published, clean, text, hero, confident, assets


def new_pages(pages: DataFrame, articles: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose clean link is not stored, one for each link, with that link: the first by its address, then by its other columns."""
    keyed = pages.withColumn("_link", F.coalesce(clean_link(url), X.trim_space(url)))
    return first_per_key(keyed.join(articles.select(F.col("link").alias("_link")), "_link", "left_anti"), "_link", [url])


def pages_of(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(_link, html): one page for each of the links, the first by its html. Other pages go before any html is shuffled."""
    keyed = pages.select(F.coalesce(clean_link("url"), X.trim_space("url")).alias("_link"), "html")
    return first_per_key(keyed.join(links.select(F.col("link").alias("_link")), "_link", "left_semi"), "_link", ["html"])


def settled(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """(url, attempt, kind, status, html) of the attempt that settles each page: the first that succeeds (no kind of error) or whose
    error will not pass, within the retries; else the last of them."""
    stops = F.col("kind").isNull() | ~X.is_transient("kind", "status")
    rank = F.struct(F.when(stops, 0).otherwise(1).alias("late"), F.when(stops, F.col("attempt")).otherwise(-F.col("attempt")).alias("place"), "attempt", "kind", "status", "html")
    best = attempts.where(F.col("attempt") <= retries).groupBy("url").agg(F.min(rank).alias("_b"))
    return best.select("url", *[F.col("_b")[c].alias(c) for c in ("attempt", "kind", "status", "html")])


def capture(pages: DataFrame, now: str, url: str = "url", html: str = "html", published: str | None = None) -> DataFrame:
    """Readable view of each page with its metadata; pages without content become rows that say so. A page's own title, excerpt,
    image and time count where it is readable; then its time is the column `published`, if one is given, else now."""
    got = pages.withColumn("_c", captured(url, html))
    own = lambda name: F.col(f"_c.{name}")
    text = X.strip_tags(F.coalesce(own("text_html"), F.col(html)))
    failed = F.col(html).isNull() | own("link").isNull()
    link = F.coalesce(own("link"), X.trim_space(url))
    columns = {
        "title": F.when(failed, F.coalesce(link_host(url), link)).otherwise(F.coalesce(X.clean_title(own("title")), F.lit("Untitled"))),
        "link": link,
        "final_url": F.coalesce(own("final_url"), link),
        "excerpt": F.when(failed, "").otherwise(F.coalesce(own("excerpt"), X.excerpt(text))),
        "content_html": F.when(failed, "").otherwise(own("content_html")),
        "hero_url": F.when(~failed, own("hero_url")),
        "published_at": F.coalesce(F.when(~failed, own("published")), F.col(published) if published else F.lit(None).cast("string"), F.lit(now)),
        "fetched_at": F.lit(now),
        "read_time_min": F.when(failed, 0).otherwise(X.read_time(text)).cast("long"),
        "extraction_confident": F.when(failed, False).otherwise(own("confident")),
        "assets": F.coalesce(own("assets"), F.array().cast("array<string>")),
        "capture_failed": failed,
        "capture_error": F.when(failed, F.when(own("link").isNull(), "invalid URL").otherwise("no page")),
    }
    return got.select(*pages.columns, *[c.alias(n) for n, c in columns.items() if n not in pages.columns])


def localize(captured: DataFrame, stored: DataFrame, key: str = "link") -> DataFrame:
    """Point asset references at stored copies. stored: (key, url, path) of the assets that were kept."""
    paths = stored.groupBy(key).agg(F.collect_list(F.struct("url", "path")).alias("_paths"))
    joined = captured.join(paths, key, "left")
    return joined.withColumn("content_html", H.localized("content_html", "final_url", "_paths")).drop("_paths")
