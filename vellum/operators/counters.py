"""Counts of articles by source, category and tag, kept by what each change adds and takes away.

A change of some buckets of articles is told by their rows before and after: the difference of their counts is a few signed rows. Those are
added to a log in the same version as the change, under a batch name of their own, so that changes of different buckets do not wait for
each other; a counter is the sum of its rows, never below zero. Folding replaces the log by its sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store

#: The log: a table of the store with the key `batch`.
DELTAS = "batch string, kind string, name string, n bigint"


def counts(articles: DataFrame) -> DataFrame:
    """(kind, name, n) by counting: sources, categories and tags of some articles; a tag counts once an article."""
    one = lambda kind, name: F.array(F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    tags = F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name")))
    facts = articles.select(F.explode(F.concat(one("source", F.col("source_id")), one("category", F.col("category_id")), tags)).alias("f"))
    return facts.where("f.name is not null").groupBy("f.kind", "f.name").agg(F.count(F.lit(1)).alias("n"))


def deltas(before: DataFrame, after: DataFrame, batch: str) -> DataFrame:
    """What a change adds to each counter, without those that it leaves as they were."""
    signed = counts(after).unionByName(counts(before).withColumn("n", -F.col("n")))
    return signed.groupBy("kind", "name").agg(F.sum("n").alias("n")).where("n <> 0").select(F.lit(batch).alias("batch"), "kind", "name", "n")


def counters(log: DataFrame) -> DataFrame:
    """(kind, name, n) of all that is counted now."""
    return log.groupBy("kind", "name").agg(F.greatest(F.lit(0), F.sum("n")).alias("n")).where("n > 0")


def counted_change(store: Store, links: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Apply a change of articles to the buckets of some links, and log what it adds and takes away in the same version."""
    batch = uuid.uuid4().hex
    name = store.spark.createDataFrame([(batch,)], "batch string")

    def both(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        after = change(state["articles"])
        return {"articles": after, "deltas": state["deltas"].unionByName(deltas(state["articles"], after, batch))}

    return store.change({"articles": links, "deltas": name}, both)


def folded(store: Store) -> int:
    """Replace the log by one batch of sums; a version that a change has got ahead of is tried again."""
    return store.update(lambda state: {"deltas": counters(state["deltas"]).select(F.lit("folded").alias("batch"), "kind", "name", "n")})
