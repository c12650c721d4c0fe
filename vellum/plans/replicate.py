"""Replication of two stores that reads and writes what differs, published by conditional writes.

Each side keeps articles in buckets of their ids, with digests. A pass compares the digests from the root down, and takes the
differing buckets into sync.reconcile, with those that hold the other end of a deletion, of a link under two ids, or of an article whose
category or source gives way to another one. It publishes to the remote version that it has read or not at all, then to the local one;
if either has moved on, the pass begins again, up to ATTEMPTS times. On its own each side has a link once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, sync
from ..schemas import ARTICLES, CATEGORIES, SOURCES, TOMBSTONES
from ..sources.shared import cut
from ..sources.store import ATTEMPTS, BUCKETS, Conflict, Store

#: What a digest covers: with equal ids, times and links two rows are the same for a pass.
DIGESTED = ("id", "updated_at", "link")


def open_replica(spark: SparkSession, path: str, buckets: int = BUCKETS, articles: str = ARTICLES, sources: str = SOURCES) -> Store:
    schemas = {"articles": articles, "categories": CATEGORIES, "sources": sources, "tombstones": TOMBSTONES, "digests": digest.DIGESTS}
    return Store(spark, path, schemas, {"articles": "id"}, buckets)


def _unlike(one: DataFrame, other: DataFrame) -> DataFrame:
    """Tombstones that only one side has."""
    keys = ["entity_type", "entity_id"]
    return one.join(other, keys, "left_anti").unionByName(other.join(one, keys, "left_anti"))


def _giving_way(rows: DataFrame, others: DataFrame, kind: str) -> DataFrame:
    """Ids of categories or sources that share a natural key with another id."""
    both = rows.select("id", sync.conflict_key(kind).alias("k")).unionByName(others.select("id", sync.conflict_key(kind).alias("k"))).where("k is not null").distinct()
    return both.join(both.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "k", "left_semi").select("id")


def _elsewhere(state: dict[str, DataFrame], other: dict[str, DataFrame], mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Ids of this side's articles, in buckets that may be alike on both sides, that a pass has to see all the same."""
    articles = state["articles"]
    stones = _unlike(state["tombstones"], other["tombstones"]).where("entity_type = 'article'").select(F.col("entity_id").alias("id"))
    found = articles.select("id").join(stones, "id", "left_semi")
    new = theirs.select("id", "link").join(mine.select("id", "link"), ["id", "link"], "left_anti").select("link")
    if new.limit(1).count():  # rows that this side does not have may bring a link that it has under another id
        found = found.unionByName(articles.select("id", "link").join(new, "link", "left_semi").select("id"))
    for kind, rows, reference in (("category", "categories", "category_id"), ("source", "sources", "source_id")):
        lost = _giving_way(state[rows], other[rows], kind)
        if lost.limit(1).count():
            found = found.unionByName(articles.select("id", F.col(reference).alias("_r")).join(lost.select(F.col("id").alias("_r")), "_r", "left_semi").select("id"))
    return found


def one_pass(local: Store, remote: Store, now: Column, now_text: str) -> DataFrame:
    """(entity_type, pulled, pushed, deleted, merged) of one attempt; Conflict if a side has moved on meanwhile."""
    bases = local.version(), remote.version()
    count = local.bucket_count("articles", bases[0])
    if count != remote.bucket_count("articles", bases[1]):
        raise ValueError("the replicas have different numbers of buckets")
    sides = list(zip((local, remote), bases, strict=True))
    marks = [cut(digest.current(s, "articles", DIGESTED, v)) for s, v in sides]
    here, there = (s.read(v) for s, v in sides)
    nodes = set(digest.differing(*marks, count))
    part = lambda: [s.read_buckets("articles", sorted(nodes), v) for s, v in sides]
    mine, theirs = part()
    more = _elsewhere(here, there, mine, theirs).unionByName(_elsewhere(there, here, theirs, mine))
    nodes |= set(local.buckets_of("articles", more, count))
    mine, theirs = part()
    replicas = [sync.Replica(rows, s["categories"], s["sources"], s["tombstones"]) for rows, s in ((mine, here), (theirs, there))]
    after, _, report = sync.reconcile(*replicas, now, now_text)
    report = cut(report)
    tables = {k: cut(v) for k, v in (("articles", after.articles), ("categories", after.categories), ("sources", after.sources), ("tombstones", after.tombstones))}
    for store, version in (sides[1], sides[0]):
        _publish(store, version, sorted(nodes), tables)
    return report


def _changed(rows: DataFrame, before: DataFrame) -> bool:
    return bool(rows.exceptAll(before).limit(1).count() or before.exceptAll(rows).limit(1).count())


def _publish(store: Store, base: int, nodes: list[int], tables: dict[str, DataFrame]) -> None:
    """The buckets, and the small tables that are others now, after `base`; nothing if there are none. Then the digests of the
    buckets, which are hints: without them they are made again."""
    before = store.read(base)
    rows = {t: df.select(*before[t].columns) for t, df in tables.items()}
    small = {t: df for t, df in rows.items() if t != "articles" and _changed(df, before[t])}
    if nodes:
        base = store.change({"articles": nodes}, lambda state: {"articles": rows["articles"], **small}, reads=tuple(small), base=base)
    elif small:
        base = store.commit(small, base)
    leaves = digest.current(store, "articles", DIGESTED, base)
    if _changed(leaves, before["digests"]):
        try:
            store.commit({"digests": cut(leaves)}, base)
        except Conflict:
            pass


def replicate(local: Store, remote: Store, now: Column, now_text: str) -> DataFrame:
    """Passes until one has published to both sides."""
    for left in range(ATTEMPTS, 0, -1):
        try:
            return one_pass(local, remote, now, now_text)
        except Conflict:
            if left == 1:
                raise
    raise AssertionError
