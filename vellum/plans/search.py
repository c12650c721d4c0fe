"""Title search by postings of trigrams, kept with a store of articles, and exact.

Titles are folded as the search folds them (A to Z in lower case, nothing else), and each run of three characters has a posting with
the article's link, in buckets of the run. A needle's runs are looked up in their buckets; links that have all of them are candidates, and
the articles of those, in the buckets of their links, are tested with the search's own predicate. Needles of fewer than three
characters scan. Insertions, deletions and new titles change the postings of their own runs in the same version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, contains_ascii_ci
from ..operators import mutate
from ..schemas import ARTICLES
from ..sources.shared import cut
from ..sources.store import BUCKETS, Store

RUN = 3
POSTINGS = "run string, link string"


def open_searchable(spark: SparkSession, path: str, buckets: int = BUCKETS, articles: str = ARTICLES) -> Store:
    return Store(spark, path, {"articles": articles, "postings": POSTINGS}, {"articles": "link", "postings": "run"}, buckets)


def runs_of(title: Column) -> Column:
    """The distinct runs of three characters of a folded title; none of a shorter one."""
    folded = ascii_lower(F.coalesce(title, F.lit("")))
    places = F.sequence(F.lit(1), F.length(folded) - (RUN - 1))
    return F.when(F.length(folded) >= RUN, F.array_distinct(F.transform(places, lambda i: F.substr(folded, i, F.lit(RUN))))).otherwise(F.array().cast("array<string>"))


def postings_of(articles: DataFrame) -> DataFrame:
    return articles.select(F.explode(runs_of(F.col("title"))).alias("run"), "link")


def load(store: Store, articles: DataFrame) -> int:
    """All articles of a new store, with their postings."""
    return store.commit({"articles": articles, "postings": postings_of(articles)}, store.version())


def _changed(store: Store, articles: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Apply a change to the buckets of some rows' links; the rows have the titles, old or new, whose postings may change."""
    rows = cut(articles.select("link", "title"))

    def both(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        before = state["articles"]
        after = change(before)
        touched = rows.select("link").distinct()
        new = postings_of(after.join(touched, "link", "left_semi"))
        return {"articles": after, "postings": state["postings"].join(touched, "link", "left_anti").unionByName(new)}

    return store.change({"articles": rows, "postings": postings_of(rows)}, both)


def insert(store: Store, batch: DataFrame, order: list[str] | None = None) -> int:
    """Insert new links; those that are stored keep their title and postings."""
    new = cut(batch.join(store.read()["articles"].select("link"), "link", "left_anti").select(*batch.columns))
    return _changed(store, new, lambda articles: mutate.insert_ignore(articles, new, "link", order))


def delete(store: Store, links: DataFrame) -> int:
    gone = cut(store.read()["articles"].join(links.select("link").distinct(), "link", "left_semi").select("link", "title"))
    return _changed(store, gone, lambda articles: articles.join(gone.select("link"), "link", "left_anti"))


def retitle(store: Store, titles: DataFrame) -> int:
    """New titles by link (link, title), one for each."""
    new = cut(titles.select("link", F.col("title").alias("_new")))
    old = store.read()["articles"].join(new.select("link"), "link", "left_semi").select("link", "title")
    both = old.unionByName(new.select("link", F.col("_new").alias("title")))

    def change(articles: DataFrame) -> DataFrame:
        named = articles.join(new, "link", "left")
        return named.withColumn("title", F.coalesce("_new", "title")).select(*articles.columns)

    return _changed(store, both, change)


def candidates(store: Store, needle: str, version: int) -> DataFrame | None:
    """Links of titles that have all runs of the needle; none if it has too few characters to tell."""
    spark = store.spark
    if len(needle) < RUN:
        return None
    runs = spark.createDataFrame([(needle,)], "title string").select(F.explode(runs_of(F.col("title"))).alias("run"))
    runs = cut(runs)
    count = store.bucket_count("postings", version)
    found = store.read_buckets("postings", store.buckets_of("postings", runs, count), version).join(F.broadcast(runs), "run", "left_semi")
    return found.groupBy("link").agg(F.count_distinct("run").alias("_n")).where(F.col("_n") == runs.count()).select("link")


def find(store: Store, needle: str) -> DataFrame:
    """Articles whose title contains the needle, without regard to ASCII case; all of them for an empty one."""
    version, needle = store.version(), needle.strip()
    links = candidates(store, needle, version)
    if links is None:
        return store.read(version)["articles"].where(contains_ascii_ci("title", needle)) if needle else store.read(version)["articles"]
    links = cut(links)
    buckets = store.buckets_of("articles", links, store.bucket_count("articles", version))
    return store.read_buckets("articles", buckets, version).join(links, "link", "left_semi").where(contains_ascii_ci("title", needle))
