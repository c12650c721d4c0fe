"""Replication: classify by version, gate by tombstones, resolve conflicts, and reconcile two replicas.

Everything is a function of frames. One pass goes: purge tombstones, apply them, pull, resolve conflicts, push,
merge tombstones. A pass over its own result changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, content_hash, sync_order
from ..sources.shared import cut
from . import dedup, mutate
from .filters import keep_tombstone, newer


def conflict_key(entity_type: str) -> Column:
    """Natural key of a row: link, feed address, or the name without regard to case."""
    return {"article": F.col("link"), "source": F.col("feed_url"), "category": F.lower("name")}[entity_type]


def manifest_entries(rows: DataFrame, entity_type: str, created: str = "created_at") -> DataFrame:
    """One line about each row: key, times and a hash of the content."""
    body = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.select("id", F.lit(entity_type).alias("entity_type"), conflict_key(entity_type).alias("conflict_key"), "updated_at", F.col(created).alias("created_at"), content_hash(body).alias("content_hash"))


def live_entries(manifest: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries that no tombstone of their kind gates."""
    gone = tombstones.select("entity_type", F.col("entity_id").alias("id"))
    return manifest.join(gone, ["entity_type", "id"], "left_anti")


def classify(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, action): pull what is newer there, push what is newer here, else same. Versions compare as instants."""
    l = local.select("id", F.lit(True).alias("_l"), sync_order("updated_at").alias("_lo"))
    r = remote.select("id", F.lit(True).alias("_r"), sync_order("updated_at").alias("_ro"))
    both = l.join(r, "id", "full_outer")
    lo, ro = F.when(F.col("_l"), F.col("_lo")), F.when(F.col("_r"), F.col("_ro"))
    action = F.when(F.col("_r").isNotNull() & newer(ro, lo), "pull").when(F.col("_l").isNotNull() & newer(lo, ro), "push").otherwise("same")
    return both.select("id", action.alias("action"))


def collisions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows of one natural key under different ids."""
    l = local.select("conflict_key", F.col("id").alias("local_id"), F.col("created_at").alias("local_created"))
    r = remote.select("conflict_key", F.col("id").alias("remote_id"), F.col("created_at").alias("remote_created"))
    return l.join(r, "conflict_key").where("local_id <> remote_id")


def resolve_articles(articles: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """One article a link: the earliest, with the state of all; and (id, winner_id) of the others."""
    keyed = articles.withColumns({"conflict_key": F.col("link"), "created_at": F.col("fetched_at")})
    groups = dedup.conflict_groups(keyed).select(F.col("conflict_key").alias("link"), "winner_id", F.struct("tags", "reading_progress", "favorited").alias("_m"))
    told = articles.join(groups, "link", "left")
    losers = told.where("id <> winner_id").select("id", "winner_id")
    kept = told.where("winner_id is null or id = winner_id")
    hit = F.col("_m").isNotNull()
    values = {c: F.when(hit, F.col("_m")[c]).otherwise(F.col(c)) for c in ("tags", "reading_progress", "favorited")}
    return kept.withColumns(values | {"updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}).select(*articles.columns), losers


def resolve_named(rows: DataFrame, articles: DataFrame, entity_type: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One category or source a key; articles of the others move to it."""
    reference = {"category": "category_id", "source": "source_id"}[entity_type]
    losers = dedup.conflict_losers(rows.withColumn("conflict_key", conflict_key(entity_type)))
    moves = losers.select(F.col("id").alias(reference), F.col("winner_id").alias("_to"))
    joined = articles.join(moves, reference, "left")
    moved = joined.withColumns({reference: F.coalesce("_to", reference), "updated_at": F.when(F.col("_to").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))})
    return rows.join(losers, "id", "left_anti"), moved.select(*articles.columns), losers


@dataclass
class Replica:
    """Rows of one side: the local database, or what the bucket's manifest and blobs hold."""

    articles: DataFrame
    categories: DataFrame
    sources: DataFrame
    tombstones: DataFrame


def reconcile(local: Replica, remote: Replica, now: Column, now_text: str) -> tuple[Replica, Replica, DataFrame]:
    """New local and remote state, and a report (entity_type, pulled, pushed, deleted, merged).

    Plans are cut between the steps: each joins the state with itself, and would double the plan of the one before.
    """
    deaths = cut(dedup.earliest_tombstones(local.tombstones.unionByName(remote.tombstones).where(keep_tombstone("deleted_at", now))))
    state: dict[str, DataFrame] = {}
    tallies = []
    for kind in ("source", "category", "article"):  # so that references of later ones resolve
        here, there = ({"source": x.sources, "category": x.categories, "article": x.articles}[kind] for x in (local, remote))
        mine, theirs = mutate.apply_tombstones(here, kind, deaths), mutate.apply_tombstones(there, kind, deaths)
        actions = cut(classify(mine, theirs))
        pulled = theirs.join(actions.where("action = 'pull'").select("id"), "id", "left_semi")
        state[kind] = cut(mutate.upsert_synced(mine, pulled, ("article_count",) if kind == "source" else ()))
        deleted = here.select("id").join(state[kind].select("id"), "id", "left_anti").select(F.lit("deleted").alias("what"))
        tallies.append(actions.select(F.col("action").alias("what")).unionByName(deleted).withColumn("entity_type", F.lit(kind)))
    articles = state["article"]
    sources, articles, lost_s = resolve_named(state["source"], articles, "source", now_text)
    categories, articles, lost_c = resolve_named(state["category"], articles, "category", now_text)
    articles, lost_a = resolve_articles(cut(articles), now_text)
    for kind, lost in (("source", cut(lost_s)), ("category", cut(lost_c)), ("article", cut(lost_a))):
        deaths = mutate.tombstone(deaths, kind, now_text, lost)
        tallies.append(lost.select(F.lit("merged").alias("what"), F.lit(kind).alias("entity_type")))
    rows = tallies[0]
    for t in tallies[1:]:
        rows = rows.unionByName(t)
    n = lambda what: F.count_if(F.col("what") == what)
    report = rows.groupBy("entity_type").agg(n("pull").alias("pulled"), n("push").alias("pushed"), n("deleted").alias("deleted"), n("merged").alias("merged"))
    after = Replica(articles, categories, sources, deaths)
    return after, after, report


def folded_name(c: str = "name") -> Column:
    return ascii_lower(c)
