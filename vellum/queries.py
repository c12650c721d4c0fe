"""The library's operators as queries over the test tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html as H
from .functions import text as X
from .functions import urls as U
from .operators import counters, dedup, filters, gc, library, mutate, sync
from .plans import capture as capturing
from .plans import blobs, edits, feeds, import_runs, imports
from .plans import replicate as replication
from .plans import search
from .schemas import ARTICLE_CSV, UNCATEGORIZED
from .sources import ranges, tables
from .sources.shared import shared_root
from .sources.store import Conflict, Store
from .streaming import sources as feeds_state
from .streaming.ingest import changed_sources, seen_once
from .surrogate import ARTICLES_SQL, CATEGORIES_SQL, NOW, SOURCES_SQL, VERSIONS_SQL, articles, categories, replica_versions, sources, stamp, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WITH_A = f"with {ARTICLES_SQL} "
_WITH_C = f"with {CATEGORIES_SQL} "
_WITH_AC = f"with {ARTICLES_SQL}, {CATEGORIES_SQL} "
_WITH_S = f"with {SOURCES_SQL} "
_WITH_AS = f"with {ARTICLES_SQL}, {SOURCES_SQL} "
_CI = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FLAT = r"trim(regexp_replace({}, '[\t-\r \x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1680}}\x{{2000}}-\x{{200A}}]+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


_NOW_US = "epoch_us(timestamp '2024-06-01 00:00:00')"
_SUMMARY = "id, source_id, source_type, title, link, fetched_at, reading_state, favorited, reading_progress, category_id"

# scans


@query(_WITH_AC + f"select a.{_SUMMARY.replace(', ', ', a.')}, c.name as category_name, c.icon as category_icon from articles a left join categories c on a.category_id = c.id")
def library_scan(spark, d):
    """SC1, J1"""
    return library.list_articles(articles(spark, d), categories(spark)).drop("tags")


@query(_WITH_AC + "select title, link as url, coalesce(c.name, '') as category, array_to_string(tags, ',') as tags, fetched_at as created, cast(favorited as varchar) as favourite from articles a left join categories c on a.category_id = c.id")
def export_scan(spark, d):
    """SC2, SK1"""
    return library.export_rows(articles(spark, d), categories(spark))


@query(_WITH_A + "select id, link, title from articles where id = 'a00000007'")
def point_lookup(spark, d):
    """SC4"""
    return library.lookup(articles(spark, d), "id", "a00000007").select("id", "link", "title")


@query(_WITH_A + "select id, link from articles where link in (select 'https://example.org/en/' || cast(item_id as varchar) from benchmark)")
def batch_lookup(spark, d):
    """SC4, many keys"""
    keys = table(spark, d, "benchmark").select(F.concat(F.lit("https://example.org/en/"), F.col("item_id").cast("string")).alias("link"))
    return library.lookup_all(articles(spark, d).select("id", "link"), keys, "link")


@query(_WITH_S + "select * from sources")
def source_scan(spark, d):
    """SC5"""
    return library.sources_by_age(sources(spark, d))


@query("select 'large' as default_font_size, 'list' as default_library_view, true as autosync, cast(18 as bigint) as reader_font_size, 'medium' as reader_measure, 'normal' as reader_leading, 'serif' as reader_font, 'dark' as app_theme, cast(10 as bigint) as import_concurrency, cast(12 as bigint) as autosync_interval_hours")
def settings_record(spark, d):
    """SC6: pivot with defaults, clamp and snap"""
    rows = [("default_font_size", "large"), ("autosync", "true"), ("reader_font_size", "big"), ("app_theme", "dark"), ("import_concurrency", "40"), ("autosync_interval_hours", "15"), ("unknown", "x")]
    return library.settings_record(spark.createDataFrame(rows, "key string, value string"))


# predicates and pages


@query("select event_id, ts, user_id from events where ts < timestamp '2024-01-15 00:00:00' or (ts = timestamp '2024-01-15 00:00:00' and event_id < 5000) order by ts desc, event_id desc limit 61")
def keyset_page(spark, d):
    """FP6, T1"""
    rows = table(spark, d, "events").select("event_id", "ts", "user_id")
    return library.page_query(rows, None, 60, (datetime.datetime(2024, 1, 15), 5000), ("ts", "event_id"))


@query(_WITH_A + f"select id, title, fetched_at from articles where favorited and contains({_CI.format('title')}, 'the') and category_id = 'en' and list_has_any(tags, ['src1', 'src2', 'src3']) order by fetched_at desc, id desc limit 61")
def filtered_page(spark, d):
    """FP1 to FP5 together"""
    condition = filters.ArticleFilter(favorites=True, search=" THE ", category="en", tags=("src1", "src2", "src3"))
    return library.page_query(articles(spark, d), condition, 60).select("id", "title", "fetched_at")


@query(_WITH_A + "select id from articles where category_id is null")
def uncategorized(spark, d):
    """FP4"""
    return articles(spark, d).where(filters.ArticleFilter(category=UNCATEGORIZED).column()).select("id")


@query(_WITH_A + f"select id, title from articles where contains({_CI.format('title')}, 'éa')")
def ascii_ci_search(spark, d):
    """FP3: É does not match é"""
    return articles(spark, d).where(X.contains_ascii_ci("title", "éA")).select("id", "title")


@query(_WITH_A + "select id, title from articles where contains(lower(title), lower('éA'))")
def unicode_ci_search(spark, d):
    """FP10"""
    return articles(spark, d).where(filters.name_contains("title", "éA")).select("id", "title")


@query(_WITH_S + "select id, status from sources where type = 'rss' and status in ('active', 'error')")
def syncable_sources(spark, d):
    """FP8"""
    return sources(spark, d).where(filters.syncable_sources()).select("id", "status")


@query(_WITH_A + "select id from articles where list_contains(tags, 'fr')")
def tag_members(spark, d):
    """FP9"""
    return articles(spark, d).where(filters.has_tag("fr")).select("id")


@query(f"select * from (select 'articles' as kind, cast(p_partkey as varchar) as id from part where contains({_CI.format('p_name')}, 'red') union all select 'categories', cast(n_nationkey as varchar) from nation where contains(lower(n_name), 'red') union all select 'tags', cast(r_regionkey as varchar) from region where contains(lower(r_name), 'red'))")
def search_scopes(spark, d):
    """FP11"""
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("tag"))
    found = filters.search_scopes(parts, nations, regions, "RED ")
    out = [v.select(F.lit(k).alias("kind"), "id") for k, v in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(_WITH_S + "select case when status = 'paused' then 'paused' else 'active' end as part, count(*) as n from sources group by 1")
def active_and_paused(spark, d):
    """FP12"""
    active, paused = filters.active_and_paused(sources(spark, d))
    count = lambda df, part: df.groupBy(F.lit(part).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return count(active, "active").unionByName(count(paused, "paused"))


@query("select p_partkey, p_name, rank from (select p_partkey, p_name, case when lower(p_name) = 'part 1' then 0 when starts_with(lower(p_name), 'part 1') then 1 when contains(lower(p_name), 'part 1') then 2 end as rank from part) where rank is not null order by rank, p_name, p_partkey limit 40")
def ranked_names(spark, d):
    """FP16"""
    return filters.ranked_names(table(spark, d, "part").select("p_partkey", "p_name"), " Part 1", 1 << 30, "p_name").orderBy("rank", "p_name", "p_partkey").limit(40)


# joins and aggregations


@query("select n.n_nationkey, n.n_name as name, count(c.c_custkey) as n from nation n left join customer c on c.c_nationkey = n.n_nationkey and c.c_acctbal > 9900 group by 1, 2")
def category_counts_with_zero(spark, d):
    """J2, A5"""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    customers = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("category_id"))
    return library.category_counts(nations, customers).withColumnRenamed("id", "n_nationkey")


@query(_WITH_A + "select count(*) as total, count(*) filter (reading_state = 'unread') as unread, count(*) filter (favorited) as favorited, count(*) filter (category_id is null) as uncategorized from articles")
def library_counts(spark, d):
    """A1, A2"""
    return library.counts(articles(spark, d))


@query(_WITH_A + "select t.tag, count(*) as n from articles, unnest(tags) as t(tag) group by 1")
def tag_counts(spark, d):
    """J3, A3, T6"""
    return library.by_name(library.tag_counts(articles(spark, d)), "tag")


@query(_WITH_A + "select t.tag, count(*) as n from articles, unnest(tags) as t(tag) where category_id = 'en' and list_has_any(tags, ['src3', 'src4']) group by 1")
def tag_facet_counts(spark, d):
    """A4"""
    return library.tag_counts(articles(spark, d), filters.ArticleFilter(category="en", tags=("src3", "src4")))


@query(_WITH_A + f"select t.tag, count(*) as n from articles, unnest(tags) as t(tag) where favorited and t.tag <> 'en' group by 1 order by n desc, {_CI.format('t.tag')}, t.tag limit 7")
def facet_tags(spark, d):
    """T4"""
    return library.facet_tags(library.tag_counts(articles(spark, d), filters.ArticleFilter(favorites=True)), ("en",), True)


@query(_WITH_A + f"select t.tag, count(*) as n from articles, unnest(tags) as t(tag) where contains(lower(t.tag), 'rc1') and t.tag not in ('src1') group by 1 order by {_CI.format('t.tag')}, t.tag limit 8")
def tag_suggestions(spark, d):
    """T5"""
    return library.suggest_tags(library.tag_counts(articles(spark, d)), ("src1",), " RC1")


@query(_WITH_AC + f"select c.id, c.name, count(a.id) as n from categories c left join articles a on a.category_id = c.id group by 1, 2 order by n desc, {_CI.format('c.name')}, c.name limit 5")
def top_categories(spark, d):
    """T3"""
    return library.top_categories(library.category_counts(categories(spark).select("id", "name"), articles(spark, d)))


@query(_WITH_AC + f", t as (select c.id, c.name, count(a.id) as n from categories c left join articles a on a.category_id = c.id group by 1, 2), o as (select *, row_number() over (order by n desc, {_CI.format('name')}, name) as place from t) select id, name, n, cast(place as int) as place from o where place <= 5 union all select '__uncategorized__', 'Uncategorized', count(*), 0 from articles where category_id is null")
def sidebar_categories(spark, d):
    """T3 with the pinned entry"""
    rows = articles(spark, d)
    return library.sidebar_categories(library.category_counts(categories(spark).select("id", "name"), rows), rows)


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n <= 3")
def recent_of_each(spark, d):
    """T2, all sources at once"""
    return library.recent_of_each(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("select event_id, event_type from events order by ts desc, event_id desc limit 20")
def recent_of_all(spark, d):
    """T2"""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type")


@query("select conv_id, turn, role from conversations where turn < 3")
def first_of_sequence(spark, d):
    """T7: the first items of each sequence in their order"""
    return feeds.first_entries(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3).drop("place")


@query(_WITH_A + "select id, link from articles where fetched_at >= '2024-01-02' and id not in (select id from articles where reading_state = 'unread')")
def not_loaded(spark, d):
    """J13"""
    rows = articles(spark, d).select("id", "link", "fetched_at", "reading_state")
    return library.not_loaded(rows.where("fetched_at >= '2024-01-02'"), rows.where("reading_state = 'unread'").select("id")).select("id", "link")


@query(_WITH_A + "select id, link from articles where link not in (select 'https://example.org/' || l || '/' || cast(item_id as varchar) from benchmark, (values ('en'), ('de'), ('fr'), ('es')) v(l))")
def new_only(spark, d):
    """J5"""
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]))
    stored = table(spark, d, "benchmark").select("item_id", langs.alias("l")).select(F.concat(F.lit("https://example.org/"), F.col("l"), F.lit("/"), F.col("item_id").cast("string")).alias("link"))
    return library.not_loaded(articles(spark, d).select("id", "link"), stored, "link")


@query(_WITH_A + "select source_id, count(*) as article_count from articles where source_id is not null group by 1")
def source_counts(spark, d):
    """A6"""
    return dedup.source_counts(articles(spark, d))


# dedup and conflicts


@query("select user_id, ts, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def newest_per_key(spark, d):
    """A9, J14"""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return dedup.newest_per_key(rows, ["user_id"], ["ts", "event_id"])


@query(_WITH_S + "select s.id, s.feed_url, cast(t.n as bigint) as article_count from sources s join (select feed_url, max(created_at) as m, sum(article_count) as n from sources group by 1) t on s.feed_url = t.feed_url and s.created_at = t.m union all select id || '-none', null, article_count from sources")
def collapse_sources(spark, d):
    """A10, survivors; sources without a feed stay"""
    rows = sources(spark, d)
    rows = rows.unionByName(rows.withColumns({"id": F.concat("id", F.lit("-none")), "feed_url": F.lit(None).cast("string")}))
    return dedup.collapse_sources(rows, articles(spark, d))[0].select("id", "feed_url", "article_count")


@query(_WITH_AS + ", t as (select id, last_value(id) over (partition by feed_url order by created_at, id rows between unbounded preceding and unbounded following) as w from sources) select a.id, coalesce(t.w, a.source_id) as source_id from articles a left join t on a.source_id = t.id")
def repointed_articles(spark, d):
    """A10, articles that move"""
    return dedup.collapse_sources(sources(spark, d), articles(spark, d))[1].select("id", "source_id")


@query(_WITH_A + "select link as conflict_key, arg_min(id, fetched_at || id) as winner_id, max(reading_progress) as reading_progress, bool_or(favorited) as favorited, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') as tags from articles group by link")
def conflict_winner_merge(spark, d):
    """A13 to A15"""
    rows = articles(spark, d).withColumns({"conflict_key": F.col("link"), "created_at": F.col("fetched_at")})
    return dedup.merged_state(rows).withColumn("tags", F.array_join("tags", ","))


@query(_WITH_A + ", k as (select * from articles where id not like '%5' and id not like '%6'), w as (select link, arg_min(id, fetched_at || id) as winner_id, count(*) as n from k group by link) select a.id, w.winner_id from k a join w on a.link = w.link where n > 1 and a.id <> w.winner_id")
def conflict_losers(spark, d):
    """A13; empty and missing keys collide with nothing"""
    key = F.when(F.col("id").endswith("5"), "").when(~F.col("id").endswith("6"), F.col("link"))
    return dedup.conflict_losers(articles(spark, d).withColumns({"conflict_key": key, "created_at": F.col("fetched_at")}))


@query("select doc_id, sha256(coalesce(text, '')) as content_hash, first_value(doc_id) over (partition by sha256(coalesce(text, '')) order by doc_id) as stored_path from documents")
def content_hash_dedup(spark, d):
    """A16: equal contents share the first path"""
    assets = table(spark, d, "documents").select(F.lit(1).alias("owner"), F.coalesce("text", F.lit("")).alias("body"), F.col("doc_id").alias("url"), F.col("doc_id").alias("path"))
    return dedup.one_path_per_content(assets, "owner").select(F.col("url").alias("doc_id"), "content_hash", "stored_path")


@query("select doc_id, case row_number() over (partition by coalesce(text, '') order by doc_id) when 1 then 'literal' when 2 then 'promote' else 'pointer' end as action from documents")
def image_sightings(spark, d):
    """A17"""
    entries = table(spark, d, "documents").select("doc_id", X.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return dedup.sightings(entries, spark.createDataFrame([], "content_hash string, promoted boolean"), ["doc_id"]).select("doc_id", "action")


@query("select sha256(coalesce(text, '')) as content_hash, count(*) >= 2 as promoted from documents group by coalesce(text, '')")
def sighting_ledger(spark, d):
    """A17, ledger after the pass"""
    entries = table(spark, d, "documents").select(X.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return dedup.updated_ledger(entries, spark.createDataFrame([], "content_hash string, promoted boolean"))


@query(_WITH_A + ", s as (select distinct link from articles where reading_state = 'read') select count(distinct link) filter (link not in (from s)) as added, count(*) - count(distinct link) filter (link not in (from s)) as skipped from articles")
def seen_set(spark, d):
    """A18, ST2"""
    rows = articles(spark, d).select("link", "reading_state")
    return dedup.new_and_known(rows.select("link"), rows.where("reading_state = 'read'").select("link").distinct(), "link")[1]


@query("""with e as (select event_type as entity_type, cast(user_id as varchar) as entity_id, epoch(ts) // 1 as sec,
  case event_id % 3 when 0 then strftime(ts + interval 2 hour, '%Y-%m-%dT%H:%M:%S') || '+02:00' when 1 then strftime(ts - interval 5 hour, '%Y-%m-%dT%H:%M:%S') || '-05:00' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as t from events)
select entity_type, entity_id, t as deleted_at from e qualify row_number() over (partition by entity_type, entity_id order by sec, t) = 1""")
def earliest_tombstones(spark, d):
    """A19: the earliest instant, in whatever zone it is written"""
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = lambda hours, zone: F.concat(F.date_format(F.timestamp_seconds(F.unix_timestamp(ts) + hours * 3600), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    at = F.when(n == 0, text(2, "+02:00")).when(n == 1, text(-5, "-05:00")).otherwise(text(0, "Z"))
    return dedup.earliest_tombstones(table(spark, d, "events").select(F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), at.alias("deleted_at")))


# sync


@query(f"with {VERSIONS_SQL} select coalesce(l.id, r.id) as id, case when r.id is not null and (l.id is null or r.updated_at > l.updated_at) then 'pull' when l.id is not null and (r.id is null or l.updated_at > r.updated_at) then 'push' else 'same' end as action from l full join r on l.id = r.id")
def lww_classify(spark, d):
    """J6, FP13, M7"""
    return sync.classify(*replica_versions(spark, d))


@query(_WITH_A + "select l.link as conflict_key, l.id as local_id, l.fetched_at as local_created, r.id as remote_id, r.fetched_at as remote_created from articles l join articles r on l.link = r.link and l.id <> r.id where l.source_type = 'direct' and r.source_type = 'rss'")
def key_collisions(spark, d):
    """J7"""
    rows = articles(spark, d).select("id", F.col("link").alias("conflict_key"), F.col("fetched_at").alias("created_at"), "source_type")
    return sync.collisions(rows.where("source_type = 'direct'"), rows.where("source_type = 'rss'"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)")
def tombstone_gate(spark, d):
    """J8"""
    manifest = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.lit("article").alias("entity_type"))
    gone = table(spark, d, "labels").where("toxic = 1").select(F.lit("article").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id"))
    return sync.live_entries(manifest, gone).select("doc_id")


@query(f"select event_id from events where event_id % 50 = 0 or {_NOW_US} - epoch_us(ts) < cast(60 as bigint) * 86400000000")
def tombstone_retention(spark, d):
    """FP14, ST6: unparseable times are kept"""
    at = F.when(F.col("event_id") % 50 == 0, "not a time").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return table(spark, d, "events").withColumn("deleted_at", at).where(filters.keep_tombstone("deleted_at", _now())).select("event_id")


@query(f"select event_id from events where event_id % 50 <> 0 and {_NOW_US} - epoch_us(ts) > cast(1 as bigint) * 3600000000")
def grace_period(spark, d):
    """FP15: unparseable times are too recent"""
    at = F.when(F.col("event_id") % 50 == 0, "not a time").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return table(spark, d, "events").withColumn("modified", at).where(filters.past_grace("modified", _now())).select("event_id")


@query(_WITH_A + "select id, 'article' as entity_type, link as conflict_key, updated_at, fetched_at as created_at from articles")
def manifest_entries(spark, d):
    """SC3: one line about each row"""
    return sync.manifest_entries(articles(spark, d), "article", "fetched_at").drop("content_hash")


@query(_WITH_A + """, w as (select link, arg_min(id, fetched_at || id) as id, count(*) as n, max(reading_progress) as p, bool_or(favorited) as f from articles group by link)
select a.id, coalesce(case when w.n > 1 then w.p end, a.reading_progress) as reading_progress, case when w.n > 1 then w.f else a.favorited end as favorited, case when w.n > 1 then '2024-06-01T00:00:00Z' else a.updated_at end as updated_at from articles a join w on a.id = w.id""")
def resolve_articles(spark, d):
    """A15"""
    rows = articles(spark, d).drop("content")
    return sync.resolve_articles(rows, NOW)[0].select("id", "reading_progress", "favorited", "updated_at")


@query(_WITH_AS + """, a as (select cast(substr(id, 2) as int) as n from articles), l as (select n, n % 7 as v from a where n % 3 <> 0 and n % 10 <> 0), r as (select n, n % 5 as v from a where n % 4 <> 0 and n % 10 <> 0),
u as (select coalesce(l.n, r.n) as n, case when r.n is not null and (l.n is null or r.v > l.v) then 'pull' when l.n is not null and (r.n is null or l.v > r.v) then 'push' end as what from l full join r on l.n = r.n)
select 'article' as entity_type, count(*) filter (what = 'pull') as pulled, count(*) filter (what = 'push') as pushed, (select count(*) from a where n % 3 <> 0 and n % 10 = 0) as deleted, count(*) - count(distinct n // 2) as merged from u
union all select 'category', 1, 0, 0, 1
union all select 'source', 0, count(*) filter (cast(regexp_replace(id, '[^0-9]', '', 'g') as int) % 2 = 0), 0, count(*) - count(distinct feed_url) from sources""")
def replication_report(spark, d):
    """ST5, D-17 to D-19: a whole pass over two replicas: newer versions both ways, deletions in and beyond retention, conflicts of all three kinds"""
    n = F.substring("id", 2, 8).cast("int")
    rows = articles(spark, d).drop("content").withColumns({"n": n, "link": F.concat(F.lit("https://e.com/"), F.floor(n / 2).cast("string"))})
    side = lambda keep, mod: rows.where(keep).withColumn("updated_at", stamp(F.lit(1_704_067_200) + F.col("n") % mod)).drop("n")
    dead = lambda keep, at: rows.where(keep).select(F.lit("article").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(at).alias("deleted_at"))
    named = categories(spark)
    more = spark.createDataFrame([("rr", "ENGLISH", "folder", NOW, NOW)], named.schema)
    feeds_ = sources(spark, d).withColumn("updated_at", F.col("created_at")).select("id", "name", "feed_url", "article_count", "created_at", "updated_at")
    local = sync.Replica(side("n % 3 <> 0", 7), named, feeds_, dead("n % 10 = 0", "2024-05-30T00:00:00Z"))
    remote = sync.Replica(side("n % 4 <> 0", 5), named.unionByName(more), feeds_.where(_number("id") % 2 == 1), dead("n % 15 = 0", "2020-01-01T00:00:00Z"))
    return sync.reconcile(local, remote, _now(), NOW)[2]


def _drifted(spark, d):
    """Two stores of one library, of which some rows went different ways."""
    n = F.expr("cast(substr(id, 2) as int)")
    rows = articles(spark, d).drop("content").withColumns({"n": n, "link": F.concat(F.lit("https://e.com/"), n.cast("string"))})
    aged = lambda later: rows.withColumn("updated_at", stamp(F.lit(1_704_067_200) + F.when(n % 50 == later, 9).otherwise(1)))
    dead = lambda left, least: rows.where(n % left == least).select(F.lit("article").alias("entity_type"), F.col("id").alias("entity_id"), F.lit("2024-05-30T00:00:00Z").alias("deleted_at"))
    here = aged(2).where("n % 90 <> 4 and n % 110 <> 5").drop("n")
    there = aged(1).where("n % 70 <> 3 and n % 115 <> 7").withColumn("id", F.when(n % 130 == 6, F.concat(F.lit("z"), "id")).otherwise(F.col("id"))).drop("n")
    feeds_ = sources(spark, d).groupBy("feed_url").agg(F.min("id").alias("id"), F.min("name").alias("name"), F.min("created_at").alias("created_at"), F.max("article_count").alias("article_count")).withColumn("updated_at", F.col("created_at"))
    stores = []
    for name, mine, stones in (("local", here, dead(110, 5)), ("remote", there, dead(115, 7))):
        store = replication.open_replica(spark, _scratch(spark, name), 64, mine.schema.toDDL().replace("`", ""), "id string, name string, feed_url string, article_count bigint, created_at string, updated_at string")
        store.commit({"articles": mine, "categories": categories(spark), "sources": feeds_, "tombstones": stones}, 0)
        stores.append(store)
    return stores


_DRIFTED_SQL = """, a as (select cast(substr(id, 2) as int) as n, id from articles), s as (
  select n, id, n % 90 <> 4 and n % 110 <> 5 as l, n % 70 <> 3 and n % 115 <> 7 as r, n % 130 = 6 as z, n % 110 = 5 or n % 115 = 7 as dead, n % 50 = 2 as lnew, n % 50 = 1 as rnew from a)"""


@query(_WITH_A + _DRIFTED_SQL + """ select 'article' as entity_type, count(*) filter ((r and not z and not dead and (not l or rnew)) or (r and z)) as pulled,
  count(*) filter (l and not dead and (not r or z or lnew)) as pushed, count(*) filter (l and dead) as deleted, count(*) filter (z and l and r and not dead) as merged from s
union all select 'category', 0, 0, 0, 0 union all select 'source', 0, 0, 0, 0""")
def digest_replication(spark, d):
    """ST5, J6, SC14: a pass over two stores that reads the buckets whose digests differ, published by conditional writes"""
    return replication.replicate(*_drifted(spark, d), _now(), NOW)


@query(_WITH_A + _DRIFTED_SQL + """, e as (select case when z and r and (dead or not l) then 'z' || id else id end as id, l, r, z, dead from s) select id, 'both' as side from e where (l or r) and not (dead and not (z and r))""")
def replicas_after(spark, d):
    """ST5: what both sides have after the pass"""
    local, remote = _drifted(spark, d)
    replication.replicate(local, remote, _now(), NOW)
    a, b = (s.read()["articles"].select("id", F.lit(side).alias("side")) for s, side in ((local, "local"), (remote, "remote")))
    both = a.unionByName(b).groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("side").alias("side"))
    return both.select("id", F.when(F.col("_n") == 2, "both").otherwise(F.col("side")).alias("side"))


# sweeps


@query("select 'content/a' || lpad(cast(doc_id as varchar), 8, '0') || '/x.jpg' as key from documents where doc_id % 9 = 0")
def orphan_content(spark, d):
    """J9: files of articles that are gone"""
    rows = articles(spark, d).select("id", F.substring("id", 2, 8).cast("int").alias("n"))
    listing = rows.select(F.concat(F.lit("content/"), F.col("id"), F.lit("/x.jpg")).alias("key"))
    return gc.orphan_content(listing, rows.where("n % 9 <> 0"))


@query("select 'sync/blobs/articles/a' || lpad(cast(doc_id as varchar), 8, '0') || '/meta.json.gz' as key from documents where doc_id % 9 = 0 and doc_id % 2 = 0")
def orphan_blobs(spark, d):
    """J10: past grace, in no manifest, not shared"""
    rows = articles(spark, d).select("id", F.substring("id", 2, 8).cast("int").alias("n"), F.lit("article").alias("entity_type"))
    old = F.when(F.col("n") % 2 == 0, "2024-05-01T00:00:00Z").otherwise("2024-05-31T23:30:00Z")
    listing = rows.select(X.blob_key("entity_type", "id").alias("key"), old.alias("last_modified")).unionByName(rows.select(X.shared_image_key("id").alias("key"), F.lit("2024-01-01T00:00:00Z").alias("last_modified")))
    return gc.orphan_blobs(listing, rows.where("n % 9 <> 0"), _now()).select("key")


# text


@query(r"select page_id, case when regexp_matches(html, '(?s)<title[^>]*>.*?</title>') then trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) end as title from pages")
def page_title_text(spark, d):
    """H3"""
    return table(spark, d, "pages").select("page_id", X.tag_text("html", "title").alias("title"))


@query(r"select page_id, sha256(regexp_replace(html, '(?s)<[^>]*(>|$)|>', '', 'g')) as h from pages")
def page_strip_tags(spark, d):
    """H4"""
    return table(spark, d, "pages").select("page_id", F.sha2(X.strip_tags("html"), 256).alias("h"))


@query(f"select doc_id, case when length({_FLAT.format('text')}) <= 200 then {_FLAT.format('text')} else rtrim(substr({_FLAT.format('text')}, 1, 200)) || '…' end as excerpt from documents")
def doc_excerpt(spark, d):
    """H5"""
    return table(spark, d, "documents").select("doc_id", X.excerpt("text").alias("excerpt"))


@query(f"select doc_id, greatest(1, (case when {_FLAT.format('text')} = '' then 0 else length({_FLAT.format('text')}) - length(replace({_FLAT.format('text')}, ' ', '')) + 1 end) // 200) as minutes from documents")
def doc_read_time(spark, d):
    """H6"""
    return table(spark, d, "documents").select("doc_id", X.read_time("text").alias("minutes"))


@query(f"select doc_id, substr({_FLAT.format('regexp_replace(text, ' + chr(39) + '[\\x00-\\x1F\\x7F]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, 1, 300) as title from documents")
def clean_titles(spark, d):
    """H7"""
    return table(spark, d, "documents").select("doc_id", X.clean_title("text").alias("title"))


@query("select page_id, coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)), '^www\\.', ''), ''), url) as host from pages")
def page_host(spark, d):
    """U9"""
    return table(spark, d, "pages").select("page_id", U.host_of("url").alias("host"))


@query("select page_id, case when contains(trim(url), '://') then trim(url) else 'https://' || trim(url) end as u from (select page_id, case when page_id % 2 = 0 then url else ' ' || regexp_replace(url, '^https?://', '') end as url from pages)")
def typed_address(spark, d):
    """U3"""
    raw = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit(" "), F.regexp_replace("url", "^https?://", "")))
    return table(spark, d, "pages").select("page_id", U.source_url(raw).alias("u"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_prop(spark, d):
    """M1"""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("select doc_id, case when doc_id % 5 = 0 then '' else lang || '|' || source end as tags, '[\"' || lang || '\",\"' || source || '\"]' as js from documents")
def tag_json(spark, d):
    """M1, M2: malformed lists are empty"""
    raw = F.when(F.col("doc_id") % 5 == 0, "{oops").otherwise(X.tags_json(F.array("lang", "source")))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.parse_tags(raw), "|").alias("tags"), X.tags_json(F.array("lang", "source")).alias("js"))


@query("select doc_id, lang || '|' || source as tags from documents")
def tag_normalize(spark, d):
    """A11, M3"""
    cell = F.concat_ws(",", F.upper("lang"), F.concat(F.lit("  "), F.col("lang")), F.lit(" "), F.concat(F.lit("\t"), F.col("source"), F.lit(" ")), F.upper("source"))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.normalize_tags(X.split_tags(cell)), "|").alias("tags"))


@query("select doc_id, 'a|' || lang || '|' || source as tags from documents")
def tag_normalize_sorted(spark, d):
    """A12"""
    tags = F.array(F.col("source"), F.concat(F.col("lang"), F.lit(" ")), F.lit(""), F.lit("A"), F.lit("a"))
    return table(spark, d, "documents").where("lang is not null").select("doc_id", F.array_join(X.normalize_tags_sorted(tags), "|").alias("tags"))


@query("select doc_id, case doc_id % 3 when 0 then 'Uncategorized' when 1 then lang else 'Uncategorized' end as folder, case doc_id % 3 when 1 then lang end as key, doc_id % 2 = 0 as flag from documents")
def folders_and_flags(spark, d):
    """M4, M5"""
    n = F.col("doc_id")
    cell = F.when(n % 3 == 0, "  UnSorted ").when(n % 3 == 1, F.concat(F.lit(" "), F.col("lang"))).otherwise("\t")
    return table(spark, d, "documents").select("doc_id", X.folder_name(cell).alias("folder"), X.folder_key(cell).alias("key"), X.flag(F.when(n % 2 == 0, " TRUE ").otherwise("yes")).alias("flag"))


@query("select doc_id, sha256(coalesce(text, '')) as h, 'sync/blobs/articles/' || cast(doc_id as varchar) || '/content.tar.gz' as k1, 'sync/blobs/shared-images/' || cast(doc_id as varchar) as k2, 'sync/blobs/categories/' || cast(doc_id as varchar) || '/meta.json.gz' as k3 from documents")
def hashes_and_keys(spark, d):
    """M6, M11"""
    i = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.coalesce("text", F.lit(""))).alias("h"), X.images_key(i).alias("k1"), X.shared_image_key(i).alias("k2"), X.blob_key(F.lit("category"), i).alias("k3"))


@query("select doc_id, case when abs(6 - n) <= abs(12 - n) and abs(6 - n) <= abs(24 - n) then 6 when abs(12 - n) <= abs(24 - n) then 12 else 24 end as hours, least(24, greatest(1, n)) as clamped from (select doc_id, n_chars % 40 as n from documents)")
def interval_snap(spark, d):
    """T9, M8"""
    n = F.col("n_chars") % 40
    return table(spark, d, "documents").select("doc_id", X.nearest(n).alias("hours"), X.clamp(n, 1, 24).alias("clamped"))


@query("select doc_id, case when doc_id % 2 = 0 then 'unread' when doc_id % 3 = 0 then 'read' else 'reading' end as state from documents")
def state_remap(spark, d):
    """M10"""
    return table(spark, d, "documents").select("doc_id", X.reading_state(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 3).cast("double")).alias("state"))


@query(f"""with m as (select event_id, cast(floor(({_NOW_US} - epoch_us(ts)) / 60e6 + 0.5) as bigint) as n from events), h as (select *, cast(floor(n / 60.0 + 0.5) as bigint) as h from m), w as (select *, cast(floor(h / 24.0 + 0.5) as bigint) as w from h)
select event_id, case when n < 1 then 'just now' when n < 60 then n || ' min ago' when h < 24 then h || ' hour' || case when h = 1 then '' else 's' end || ' ago' else w || ' day' || case when w = 1 then '' else 's' end || ' ago' end as ago from w""")
def relative_times(spark, d):
    """M9"""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return table(spark, d, "events").select("event_id", X.relative_time(at, _now()).alias("ago"))


@query("select page_id, case page_id % 5 when 0 then 'image/jpeg' when 1 then 'image/svg+xml' when 2 then 'application/octet-stream' when 3 then 'video/webm' else 'application/octet-stream' end as type from pages")
def media_types(spark, d):
    """SK7"""
    n = F.col("page_id") % 5
    path = F.when(n == 0, "a/b.c.JPG").when(n == 1, "x.svg").when(n == 2, "x").when(n == 3, "v.webm").otherwise("x.")
    return table(spark, d, "pages").select("page_id", X.media_type(path).alias("type"))


@query("select page_id, page_id % 6 in (0, 1, 2, 4) as again from pages")
def transient_errors(spark, d):
    """H13"""
    n = F.col("page_id") % 6
    kind = F.when(n == 0, "transport").otherwise("status")
    status = F.when(n == 1, 503).when(n == 2, 429).when(n == 3, 404).when(n == 4, 408).when(n == 5, 301)
    return table(spark, d, "pages").select("page_id", X.is_transient(kind, status).alias("again"))


# imports


def _bookmarks(spark, d):
    rows = articles(spark, d).select("title", F.concat("link", F.lit("?utm_source=x#top")).alias("url"), F.when(F.col("category_id").isNull(), "Unsorted").otherwise(F.col("category_id")).alias("folder"), F.lit("A, b,,a").alias("tags"), F.col("fetched_at").alias("created"), F.lit("true").alias("favorite"))
    return rows, articles(spark, d).where("reading_state = 'read'")


@query(_WITH_A + ", s as (select distinct link from articles where reading_state = 'read') select coalesce(category_id, 'Uncategorized') as folder, count(*) as rows, count(*) filter (link in (from s)) as duplicates from articles group by 1")
def import_preview(spark, d):
    """A7, U1, U2, U8"""
    rows, stored = _bookmarks(spark, d)
    return imports.preview(rows, stored, X.folder_key("folder"))


@query(_WITH_A + """, r as (select *, substr(id, 8, 2) = '00' as bad from articles), s as (select distinct link from articles where reading_state = 'read'),
f as (select distinct link from articles where link like '%7'), o as (select case when bad then 'failed' when link in (from s) or row_number() over (partition by link, bad order by id) > 1 then 'skipped' when link in (from f) then 'failed' else 'imported' end as outcome from r)
select count(*) filter (outcome = 'imported') as imported, count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'failed') as failed from o""")
def import_summary(spark, d):
    """A8, ST4b: links that do not parse and captures that failed count as failed"""
    rows = articles(spark, d).select(F.col("id").alias("line"), F.when(F.substring("id", 8, 2) == "00", F.lit("http://[bad")).otherwise(F.concat("link", F.lit("?utm_source=x#top"))).alias("url"))
    stored = articles(spark, d).where("reading_state = 'read'")
    captures = articles(spark, d).where("link like '%7'").select("link", F.lit(True).alias("capture_failed"))
    return imports.summary(imports.outcomes(rows, stored, captures))


@query(_WITH_AC + "select link, title, 'a|b' as tags, true as favorited, fetched_at, c.id as category_id from articles a left join categories c on lower(c.name) = lower(case a.category_id when 'de' then 'GERMAN' when 'en' then 'english' else 'nobody' end)")
def bookmark_fields(spark, d):
    """J12, M3 to M5"""
    rows, _ = _bookmarks(spark, d)
    named = rows.withColumn("folder", F.when(F.col("folder") == "de", "GERMAN").when(F.col("folder") == "en", "english").otherwise("nobody"))
    return imports.bookmark_articles(named, categories(spark)).withColumn("tags", F.array_join("tags", "|"))


# mutations


@query(_WITH_A + ", s as (select id, link from articles where reading_state <> 'unread'), n as (select link, min(id) as id from articles where reading_state = 'unread' group by link) select id, link from s union all select id, link from n where link not in (select link from s)")
def insert_ignore(spark, d):
    """D-1: of new rows with one link the first by id stays"""
    rows = articles(spark, d).select("id", "link", "reading_state")
    return mutate.insert_ignore(rows.where("reading_state <> 'unread'"), rows.where("reading_state = 'unread'")).select("id", "link")


@query(_WITH_A + ", s as (select id, link from articles where reading_state <> 'unread'), n as (select link, min(id) as id from articles where reading_state = 'unread' group by link), a as (select id, link from s union all select id, link from n where link not in (select link from s)) select id, link from a where link in (select link from n)")
def insert_and_return(spark, d):
    """D-1b: the stored row of each link of the batch, new or not"""
    rows = articles(spark, d).select("id", "link", "reading_state")
    return mutate.insert_and_return(rows.where("reading_state <> 'unread'"), rows.where("reading_state = 'unread'"))[1].select("id", "link")


@query(_WITH_A + ", b as (select link, min(id) as id from articles where reading_state = 'unread' group by link) select id, case when link in (select link from b) then array_to_string(list_append(tags, 'imported'), ',') else array_to_string(tags, ',') end as tags from (select id, link, [lang_of, source_id] as tags from (select *, tags[1] as lang_of from articles) where reading_state <> 'unread') union all select id, 'imported' from b where link not in (select link from articles where reading_state <> 'unread')")
def imported_rows(spark, d):
    """D-2: new links are inserted, links already there get the tags only"""
    rows = articles(spark, d).select("id", "link", "tags", "reading_state", "updated_at")
    batch = rows.where("reading_state = 'unread'").withColumn("tags", F.array(F.lit("imported")))
    return mutate.import_rows(rows.where("reading_state <> 'unread'"), batch, NOW).select("id", F.array_join("tags", ",").alias("tags"))


@query(_WITH_A + "select id, case when source_id in ('src1', 'src2') and lang_tag <> 'new' then array_to_string(list_append(tags, 'new'), ',') else array_to_string(tags, ',') end as tags, case when source_id in ('src1', 'src2') then '2024-06-01T00:00:00Z' else updated_at end as updated_at from (select *, tags[1] as lang_tag from articles)")
def tag_top_up(spark, d):
    """D-3: rows that gain no tag keep their time of change; incoming tags are folded"""
    rows = articles(spark, d).withColumn("link", F.col("id"))
    batch = rows.select("link", F.when(F.col("source_id").isin("src1", "src2"), F.array(F.col("tags")[0], F.lit(" NEW "))).otherwise(F.transform("tags", F.upper)).alias("tags"))
    return mutate.top_up_tags(rows, batch, NOW).select("id", F.array_join("tags", ",").alias("tags"), "updated_at")


@query(_WITH_A + "select id, case when list_contains(tags, 'src1') then array_to_string([tags[1], 'src2'], ',') else array_to_string(tags, ',') end as tags, case when list_contains(tags, 'src1') then '2024-06-01T00:00:00Z' else updated_at end as updated_at from articles")
def rename_tag(spark, d):
    """D-5: names are folded"""
    return mutate.rename_tag(articles(spark, d), " SRC1", "Src2 ", NOW).select("id", F.array_join("tags", ",").alias("tags"), "updated_at")


@query(_WITH_A + "select id, array_to_string(list_filter(tags, lambda t: t <> 'fr'), ',') as tags from articles")
def delete_tag(spark, d):
    """D-6"""
    return mutate.delete_tag(articles(spark, d), "FR ", NOW).select("id", F.array_join("tags", ",").alias("tags"))


@query(_WITH_A + "select id, case when id = 'a00000003' then 'b,a' else array_to_string(tags, ',') end as tags from articles")
def replace_tags(spark, d):
    """D-7"""
    return mutate.set_tags(articles(spark, d), "a00000003", [" B", "a", "b", ""], NOW).select("id", F.array_join("tags", ",").alias("tags"))


@query(_WITH_C + ", t as (select distinct lang as n from documents where lang is not null union select 'ENGLISH') select name from categories union all select n from t where lower(n) not in (select lower(name) from categories)")
def find_or_create_categories(spark, d):
    """D-8"""
    names = table(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("name")).distinct().unionByName(spark.createDataFrame([("ENGLISH",)], "name string"))
    return mutate.find_or_create_categories(categories(spark), names, NOW).select("name")


@query(_WITH_A + "select id, case when category_id = 'de' then null else category_id end as category_id, case when category_id = 'de' then '2024-06-01T00:00:00Z' else updated_at end as updated_at from articles")
def delete_category(spark, d):
    """D-9"""
    deaths = spark.createDataFrame([], "entity_type string, entity_id string, deleted_at string")
    return mutate.delete_category(categories(spark), articles(spark, d), deaths, "de", NOW)[1].select("id", "category_id", "updated_at")


@query(_WITH_AS + ", g as (select source_id, count(*) as n from articles where reading_state = 'read' and source_id <> 'src1' group by 1) select s.id, greatest(0, s.article_count - coalesce(g.n, 0)) as article_count, case when g.n is null then s.created_at else '2024-06-01T00:00:00Z' end as updated_at from sources s left join g on s.id = g.source_id")
def delete_articles(spark, d):
    """D-11, counters and time of change"""
    rows = articles(spark, d)
    deaths = spark.createDataFrame([], "entity_type string, entity_id string, deleted_at string")
    feeds_ = sources(spark, d).withColumn("updated_at", F.col("created_at"))
    return mutate.delete_articles(rows, feeds_, deaths, rows.where("reading_state = 'read' and source_id <> 'src1'").select("id"), NOW)[1].select("id", "article_count", "updated_at")


@query(_WITH_S + "select id, cast(0 as bigint) as article_count, '2024-06-01T00:00:00Z' as updated_at from sources")
def emptied_sources(spark, d):
    """D-12, counters and time of change"""
    deaths = spark.createDataFrame([], "entity_type string, entity_id string, deleted_at string")
    return mutate.delete_all_articles(articles(spark, d), sources(spark, d).withColumn("updated_at", F.col("created_at")), deaths, NOW)[1].select("id", "article_count", "updated_at")


@query(_WITH_A + "select 'article' as entity_type, id as entity_id, '2024-06-01T00:00:00Z' as deleted_at from articles union all select 'article', 'gone', '2024-01-01T00:00:00Z'")
def delete_all_articles(spark, d):
    """D-12, D-13"""
    deaths = spark.createDataFrame([("article", "a00000001", "2023-01-01T00:00:00Z"), ("article", "gone", "2024-01-01T00:00:00Z")], "entity_type string, entity_id string, deleted_at string")
    return mutate.delete_all_articles(articles(spark, d), sources(spark, d), deaths, NOW)[2]


@query(_WITH_A + """, e as (select 'a' || lpad(cast(user_id as varchar), 8, '0') as id, ts, event_id, event_type, value from events),
s as (select id, arg_max(case event_type when 'click' then 'reading' else 'read' end, lpad(cast(event_id as varchar), 12, '0')) as st, max(lpad(cast(event_id as varchar), 12, '0')) as at from e group by id)
select a.id, coalesce(s.st, a.reading_state) as reading_state, coalesce(s.at, a.updated_at) as updated_at from articles a left join s on a.id = s.id""")
def state_log(spark, d):
    """D-14: a log of reader events, the last one counts"""
    log = table(spark, d, "events").select(F.concat(F.lit("a"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("at"), F.when(F.col("event_type") == "click", "reading").otherwise("read").alias("reading_state"), F.lit(None).cast("boolean").alias("favorited"), F.lit(None).cast("double").alias("reading_progress"))
    return mutate.apply_state_log(articles(spark, d), log).select("id", "reading_state", "updated_at")


@query(_WITH_S + "select id, case when id = 'src4' then 'paused' else status end as status from (select id, case when id = 'src1' then 'active' when id = 'src2' then 'error' when id = 'src3' then 'active' else status end as status from sources)")
def source_lifecycle(spark, d):
    """D-15"""
    rows = sources(spark, d).withColumns({"last_error": F.lit(None).cast("string"), "last_synced_at": F.lit(None).cast("string"), "updated_at": F.col("created_at")})
    rows = mutate.change(rows, F.col("id") == "src4", {"status": "active"})
    rows = mutate.mark_error(mutate.toggle_pause(mutate.change(rows, F.col("id") == "src1", {"status": "paused"}), "src1", NOW), "src2", "boom", NOW)
    return mutate.toggle_pause(mutate.mark_synced(rows, "src3", NOW), "src4", NOW).select("id", "status")


@query(_WITH_A + "select id, case when doc % 4 = 0 then 'remote' else reading_state end as reading_state from (select *, cast(substr(id, 2) as int) as doc from articles)")
def upsert_by_id(spark, d):
    """D-17"""
    rows = articles(spark, d).select("id", "reading_state")
    new = rows.where(F.substring("id", 2, 8).cast("int") % 4 == 0).withColumn("reading_state", F.lit("remote"))
    return mutate.upsert_synced(rows, new)


# pages: what SQL cannot say is held against tests

_FNV = "lower(printf('%016x', cast(list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split({0}, ''), lambda c: ascii(c)::uhugeint)), lambda a, b: (xor(a::ubigint, b::ubigint)::uhugeint * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) as ubigint)))"
_LINK = "(case when len(kept) > 0 then base || '?' || array_to_string(kept, '&') else base end)"
_PAIRS = "with p as (select page_id, url, regexp_replace(url, '#.*$', '') as plain, split_part(regexp_replace(url, '#.*$', ''), '?', 1) as base, case when contains(url, '?') then list_filter(string_split(split_part(regexp_replace(url, '#.*$', ''), '?', 2), '&'), lambda x: not starts_with(x, 'utm_') and split_part(x, '=', 1) not in ('fbclid', 'gclid')) else [] end as kept from pages) "


@query(_PAIRS + f"select page_id, plain as canonical, {_LINK} as link from p")
def clean_links(spark, d):
    """U1, U2, U8"""
    return table(spark, d, "pages").select("page_id", U.canonical_url("url").alias("canonical"), U.clean_link("url").alias("link"))


@query(_PAIRS + ", q as (select *, regexp_extract(plain, '^(https?)://', 1) || '/' || regexp_extract(plain, '^https?://([^/?]+)', 1) || regexp_extract(base, '^https?://[^/]+(/.*)$', 1) || case when ends_with(base, '/') then 'index.html' else '' end as path from p), r as (select *, case when not contains(plain, '?') then path when ends_with(base, '/') then regexp_replace(path, '[.]html$', '') || '.' || substr(" + _FNV.format("plain") + ", 1, 10) || '.html' else path || '.' || substr(" + _FNV.format("plain") + ", 1, 10) end as named from q) select page_id, named as path, named || '.jpg' as forced, " + _FNV.format("url") + " as fnv from r")
def asset_paths(spark, d):
    """U4, U5, U6"""
    path = U.asset_path("url")
    return table(spark, d, "pages").select("page_id", path.alias("path"), U.forced_extension(path, "jpg").alias("forced"), U.fnv_hex("url").alias("fnv"))


@query("select page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^https?://[^/]+(/.*?)[^/]*/[^/]*$', 1) || 'a.png?x=1&y=2' as reference, page_id % 4 <> 3 as blocked from pages")
def address_checks(spark, d):
    """U7, U10"""
    n = F.col("page_id") % 4
    literal = F.when(n == 0, "http://127.0.0.1/x").when(n == 1, "http://[::ffff:10.0.0.1]/").when(n == 2, "http://0xa9fe0001/").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.absolute_reference(F.lit("../a.png?x=1&amp;y=2"), "url").alias("reference"), U.blocked_literal(literal).alias("blocked"))


#: What a hostile page may hold, and what is left of it.
_HOSTILE = """<base href="//x"><img src=x y'z onerror=alert(1)><img src=x" onerror=alert(2)><a href onx=1 =javascript:alert(3)>a</a><!--><p onclick=x>--><iframe src="https://v.example/?a&b">in</iframe><a href="java&#9;script:x" id=k>b</a><link rel=modulepreload href=m><meta http-equiv=refresh content="0;url=javascript:x"><noscript><b title="</noscript><img src=y onload=z>">c</b>"""
_HARMLESS = """<img src=x><img src=x"><a href>a</a><!--><p>--><div class="iframe-placeholder">Frame left out of the archive: <a href="https://v.example/?a&amp;b">https://v.example/?a&amp;b</a></div><a id=k>b</a><noscript></noscript><img src=y>">c</b>"""


@query("select page_id, sha256('" + _HARMLESS.replace("'", "''") + "' || regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g')) as h from pages")
def sanitized_pages(spark, d):
    """H8, H9, H10: every page behind a hostile beginning"""
    return table(spark, d, "pages").select("page_id", F.sha2(H.sanitized(F.concat(F.lit(_HOSTILE), F.col("html"))), 256).alias("h"))


@query("with t as (select p.page_id, p.html, a.attempt, case when (p.page_id + a.attempt) % 4 = 0 then 'ok' when (p.page_id + a.attempt) % 7 = 0 then 'gone' else 'busy' end as what from pages p, (values (0), (1), (2), (3), (4)) a(attempt) where a.attempt <= 2), r as (select *, row_number() over (partition by page_id order by case when what = 'busy' then 1 else 0 end, case when what = 'busy' then -attempt else attempt end) as n from t) select page_id, cast(attempt as int) as attempt, case what when 'gone' then 404 when 'busy' then 503 end as status, case when what = 'ok' then length(html) end as n from r where r.n = 1")
def settled_attempts(spark, d):
    """ST9, H13: errors that pass are tried again, so often at most"""
    pages = table(spark, d, "pages").select("page_id", "html", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("attempt"))
    turn = F.col("page_id") + F.col("attempt")
    ok, gone = turn % 4 == 0, turn % 7 == 0
    attempts = pages.select(F.col("page_id").alias("url"), F.col("attempt").cast("int"), F.when(~ok, "status").alias("kind"), F.when(ok, None).when(gone, 404).otherwise(503).alias("status"), F.when(ok, F.col("html")).alias("html"))
    return capturing.settled(attempts, 2).select(F.col("url").alias("page_id"), "attempt", "status", F.length("html").alias("n"))


@query(
    _PAIRS + f""", l as (select page_id, {_LINK} as link, p.url, html from p join pages using (page_id)), k as (select *, row_number() over (partition by link order by url, page_id) as n from l),
    c as (select *, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as inside, regexp_extract(html, '(?s)<body[^>]*>(.*?)</body>', 1) as body from k where n = 1),
    s as (select *, list_sum(list_transform(string_split_regex(inside, '<[^>]*>'), lambda x: length({_FLAT.format('x')}))) >= 250 as good from c),
    t as (select *, {_FLAT.format("regexp_replace(case when good then inside when body <> '' then body else html end, '<[^>]*(>|$)|>', '', 'g')")} as flat from s)
    select page_id, link, {_FLAT.format("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} as title, rtrim(substr(flat, 1, 200)) || case when length(flat) > 200 then '…' else '' end as excerpt,
      greatest(1, (case when flat = '' then 0 else length(flat) - length(replace(flat, ' ', '')) + 1 end) // 200)::bigint as read_time_min, good as extraction_confident, false as capture_failed,
      length(trim(case when good then inside else regexp_replace(body, '(?s)<script[^>]*>.*?</script>', '', 'g') end, chr(10) || ' '))::int as n from t"""
)
def captured_pages(spark, d):
    """H1, H2, H11, H12, A20: the capture pipeline over pages of known body"""
    pages = table(spark, d, "pages")
    stored = articles(spark, d).select("link")
    return capturing.capture(capturing.new_pages(pages, stored), NOW).select("page_id", "link", "title", "excerpt", "read_time_min", "extraction_confident", "capture_failed", F.length("content_html").alias("n"))


@query(_WITH_A + "select id, title, link, updated_at from articles")
def blob_round_trip(spark, d):
    """SC15, SK6"""
    rows = articles(spark, d).select("id", "title", "link", "updated_at")
    return tables.rows_of_blobs(tables.row_blobs(rows, "article"), "id string, title string, link string, updated_at string")


@query("select source, 'f/' || cast(doc_id as varchar) as path, case when doc_id % 2 = 0 then cast(octet_length(encode(coalesce(text, ''))) as int) end as n, case when doc_id % 2 <> 0 then sha256(coalesce(text, '')) end as pointer from documents")
def image_bundles(spark, d):
    """SK5: a bundle of whole texts for each document"""
    entries = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), X.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), (F.col("doc_id") % 2 == 0).alias("literal"))
    packed = entries.groupBy("doc_id", "source").agg(F.collect_list(F.struct("path", "body", "content_hash", "literal")).alias("entries")).select("source", tables.bundle("entries").alias("data"))
    return packed.select("source", F.explode(tables.unbundled("data")).alias("e")).select("source", "e.path", F.length("e.body").alias("n"), "e.pointer")


@query("select 'content/' || cast(page_id as varchar) || '/p.html' as key, cast(octet_length(encode(html)) as bigint) as size from pages")
def asset_files(spark, d):
    """SK4, SC13: each asset as a file, listed again by prefix"""
    folder = _scratch(spark, "assets")
    pages = table(spark, d, "pages").select(F.concat(F.lit("content/"), F.col("page_id").cast("string"), F.lit("/p.html")).alias("path"), F.col("html").alias("body"))
    tables.write_assets(pages.unionByName(spark.createDataFrame([("other/x.svg", "<svg/>")], "path string, body string")), folder)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", "/(content/.*)$", 1).alias("key"), F.col("length").alias("size"))
    return tables.list_blobs(spark, folder, "content/").join(sizes, "key").select("key", "size")


@query("select page_id, case when page_id % 3 = 0 then 404 else 200 end as status, case when page_id % 3 <> 0 then 'image/png' end as type from pages")
def content_server(spark, d):
    """SK7: a file is served while its owner is live"""
    pages = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("id"))
    return tables.served(pages.withColumn("path", F.lit("a/b.png")), pages.where("page_id % 3 <> 0")).select("page_id", "status", "type")


# more of the library, over generated inputs


@query(_WITH_S + "select name, feed_url, status, article_count, '' as last_synced_at, created_at from sources")
def source_export(spark, d):
    """SK2"""
    return tables.source_rows(sources(spark, d).withColumn("last_synced_at", F.lit(None).cast("string")))


@query("select page_id % 3 = 0 as feed, count(*) as n from pages group by 1")
def sniffed_bodies(spark, d):
    """SC16: feeds become sources, the rest single captures; a feed may begin with a long comment"""
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<?xml version='1.0'?>\n<!-- "), F.repeat(F.lit("long "), 1000), F.lit("-->\n"), F.when(F.col("page_id") % 2 == 0, "<rss version='2.0'>").otherwise("<feed>"), F.col("html"))).otherwise(F.col("html"))
    feeds, pages = tables.sniffed(table(spark, d, "pages").select("page_id", body.alias("body")))
    count = lambda df, feed: df.groupBy(F.lit(feed).alias("feed")).agg(F.count(F.lit(1)).alias("n"))
    return count(feeds, True).unionByName(count(pages, False))


@query("select page_id, page_id % 4 <> 0 as stored from pages")
def fetched_assets(spark, d):
    """SC17: assets on blocked addresses and oversized ones keep their reference"""
    pages = table(spark, d, "pages")
    url = F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("http://169.254.0.1/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("https://e.com/"), F.col("page_id").cast("string")))
    references = pages.select("page_id", url.alias("url"))
    assets = pages.where("page_id % 8 <> 4").select(url.alias("url"), F.lit(b"x").alias("body"))
    return tables.usable_assets(references, assets, U.blocked_literal("url")).select("page_id", F.col("body").isNotNull().alias("stored"))


@query("with c as (select page_id, page_id * 7 % 2000 as n, page_id * 13 % 3000 as m from pages), w as (select page_id, unnest([{'w': n, 'u': 'a', 'i': 0}, {'w': m, 'u': 'b', 'i': 1}, {'w': 800, 'u': 'c', 'i': 2}], recursive := true) from c) select page_id, u as pick from w qualify row_number() over (partition by page_id order by case when w >= 1200 then 0 else 1 end, case when w >= 1200 then w else -w end, i) = 1")
def srcset_picks(spark, d):
    """T8: the narrowest of those wide enough, else the widest; a bare URL counts as 800; any white space before a descriptor"""
    n, m = F.col("page_id") * 7 % 2000, F.col("page_id") * 13 % 3000
    raw = F.concat(F.lit("a\t"), n.cast("string"), F.lit("w,\n b  "), m.cast("string"), F.lit("w, c"))
    return table(spark, d, "pages").select("page_id", H.srcset_pick(raw).alias("pick"))


@query("select page_id, page_id % 3 <> 2 as bad from pages")
def dangerous_urls(spark, d):
    """H9"""
    n = F.col("page_id") % 3
    raw = F.when(n == 0, " \x01Java&#9;Script:x").when(n == 1, "DATA:text/html,x").otherwise("https://e.com/javascript:")
    return table(spark, d, "pages").select("page_id", H.is_dangerous(raw).alias("bad"))


@query("select page_id, 'https://e.com/' || cast(page_id as varchar) || '.png|https://e.com/p.jpg' as refs, '<img src=\"L' || cast(page_id as varchar) || '\"><video poster=\"/p.jpg\"></video>' as html from pages")
def localized_assets(spark, d):
    """A20, H11, J11"""
    i = F.col("page_id").cast("string")
    pages = table(spark, d, "pages").select("page_id", F.lit("https://e.com/x").alias("final_url"), F.concat(F.lit('<img src="'), i, F.lit('.png"><video poster="/p.jpg"></video>')).alias("content_html"))
    stored = pages.select("page_id", F.concat(F.lit("https://e.com/"), i, F.lit(".png")).alias("url"), F.concat(F.lit("L"), i).alias("path"))
    refs = F.array_join(H.asset_references("content_html", "final_url"), "|")
    return capturing.localize(pages.withColumn("refs", refs), stored, "page_id").select("page_id", "refs", F.col("content_html").alias("html"))


@query(_WITH_A + ", m as (select fetched_at, id from articles order by fetched_at desc, id desc limit 1 offset 100) select id, fetched_at from articles where favorited and (fetched_at, id) < (select (fetched_at, id) from m) order by fetched_at desc, id desc limit 50")
def ranged_page(spark, d):
    """T1, FP1, FP6: a page in the middle of a library that lies in ranges of its order, from the files it opens"""
    rows, folder = articles(spark, d).select("id", "title", "fetched_at", "favorited"), _scratch(spark, "ranges")
    ranges.write_ranges(rows, folder, files=32)
    middle = rows.orderBy(F.desc("fetched_at"), F.desc("id")).offset(100).limit(1).first()
    page, _ = ranges.ranged_page(spark, folder, filters.ArticleFilter(favorites=True), 50, (middle.fetched_at, middle.id))
    return spark.createDataFrame([(r.id, r.fetched_at) for r in page.rows], "id string, fetched_at string")  # a page


@query(_WITH_A + f", t as (select id, {_CI.format('title')} as folded from articles) select 'the' as needle, id from t where contains(folded, 'the') union all select 'eR i', id from t where contains(folded, 'er i') union all select 'ou', id from t where contains(folded, 'ou') and id not like '%7'")
def indexed_search(spark, d):
    """FP3, FP11: titles found by postings of trigrams, of which some change; the needle of two characters scans"""
    rows = articles(spark, d).select(F.col("id").alias("link"), "title", "id")
    store = search.open_searchable(spark, _scratch(spark, "search"), 32, "link string, title string, id string")
    search.load(store, rows.where("id like '%7'"))
    search.insert(store, rows)
    search.retitle(store, rows.where("id like '%5'").select("link", F.lit("nothing to see").alias("title")))
    search.retitle(store, rows.where("id like '%5'").select("link", "title"))
    found = [search.find(store, n).select(F.lit(n).alias("needle"), "id") for n in ("the", "eR i")]
    search.delete(store, rows.where("id like '%7'").select("link"))
    return found[0].unionByName(found[1]).unionByName(search.find(store, "OU").select(F.lit("ou").alias("needle"), "id"))


@query(_WITH_A + "select distinct 'media/' || id || '.jpg' as key from articles where reading_state = 'unread'")
def orphan_media(spark, d):
    """J9"""
    rows = articles(spark, d).select("id", "reading_state", F.concat(F.lit("media/"), F.col("id"), F.lit(".jpg")).alias("hero_image_path"))
    return gc.orphan_media(rows.select(F.col("hero_image_path").alias("key")), rows.where("reading_state <> 'unread'"))


@query(_WITH_A + "select id, case when source_type = 'direct' then 'new ' || id else title end as title, reading_progress, case when source_type = 'direct' then '2024-06-01T00:00:00Z' else updated_at end as updated_at from articles")
def recaptured(spark, d):
    """D-2b, D-4: new content under the same id, state stays"""
    blank = {c: F.lit(None).cast("string") for c in mutate.CONTENT if c != "title"}
    rows = articles(spark, d).drop("content").withColumns(blank)
    batch = rows.where("source_type = 'direct'").select("id", F.concat(F.lit("new "), F.col("id")).alias("title"), *mutate.CONTENT[1:])
    return mutate.recapture(rows, batch, NOW).select("id", "title", "reading_progress", "updated_at")


@query(_WITH_A + "select id, case when id = 'a00000005' then 'xx' else category_id end as category_id from articles")
def assign_category(spark, d):
    """D-10"""
    return mutate.assign_category(articles(spark, d), categories(spark), "a00000005", "xx", NOW).select("id", "category_id")


@query("select * from (values ('app_theme', 'dark'), ('import_concurrency', '5'), ('autosync_interval_hours', '24'), ('autosync', 'true'), ('old', 'kept')) t(key, value)")
def settings_update(spark, d):
    """D-16"""
    stored = spark.createDataFrame([("app_theme", "light"), ("old", "kept")], "key string, value string")
    return mutate.update_settings(stored, {"app_theme": "dark", "import_concurrency": 1, "autosync_interval_hours": 19, "autosync": True})


@query(_WITH_A + "select id, 'article' as entity_type, case when source_type = 'direct' then 'now' else updated_at end as updated_at from articles union all select 'src1', 'source', 'x'")
def replaced_entries(spark, d):
    """D-19: keyed by kind and id"""
    rows = articles(spark, d)
    old = rows.select("id", F.lit("article").alias("entity_type"), "updated_at").unionByName(spark.createDataFrame([("src1", "source", "x")], "id string, entity_type string, updated_at string"))
    new = rows.where("source_type = 'direct'").select("id", F.lit("article").alias("entity_type"), F.lit("now").alias("updated_at"))
    return mutate.replace_entries(old, new)


@query(_WITH_A + "select id, reading_state = 'read' and not favorited or reading_state <> 'read' and favorited as favorited, case when reading_state = 'unread' then 'reading' else reading_state end as reading_state from articles")
def reader_actions(spark, d):
    """D-14 as single actions, applied to many rows: a toggle and an opening"""
    rows = articles(spark, d)
    toggled = mutate.change(rows, F.col("reading_state") == "read", {"favorited": ~F.col("favorited")})
    return mutate.change(toggled, F.col("reading_state") == "unread", {"reading_state": "reading"}).select("id", "favorited", "reading_state")


@query("select distinct user_id from events")
def stream_seen_set(spark, d):
    """ST1, ST2, ST6: a stream over the files at hand, each key once, state bounded by a watermark"""
    root = _scratch(spark, "seen")
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet").select("user_id", "ts")
    seen_once(stream, "user_id", "ts", "3650 days").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long").parquet(f"{root}/out").select("user_id")


@query("""with o as (select *, case event_type when 'click' then 304 when 'error' then 500 else 200 end as status, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events where user_id is not null and ts is not null)
select cast(user_id as varchar) as source, count(*) as visits, count(*) filter (status = 304) as skips, count(*) filter (status = 500) as errors,
  max(case when back = 1 then case when status = 500 then 'error' else 'active' end end) as status, arg_max(case when status = 200 then 'v' || event_id end, case when status = 200 then ts end) as etag,
  epoch_us(max(ts)) + cast(case user_id % 3 when 0 then 6 when 1 then 12 else 24 end as bigint) * 3600000000 as due_us from o group by user_id""")
def source_replay(spark, d):
    """ST1, ST3: fetch outcomes of a stream, by source: visits, skips, errors, validators and due times in keyed state"""
    root, kind = _scratch(spark, "replay"), F.col("event_type")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    status = F.when(kind == "click", 304).when(kind == "error", 500).otherwise(200)
    hours = F.element_at(F.array(F.lit(5), F.lit(13), F.lit(30)), (F.col("user_id") % 3 + 1).cast("int"))
    blank = F.lit(None).cast("string")
    outcomes = events.select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("etag"), blank.alias("last_modified"), blank.alias("error"), hours.alias("interval_hours"))
    feeds_state.keep_states(feeds_state.source_states(outcomes, late="3650 days", keep_days=36500), f"{root}/out", f"{root}/ck").awaitTermination()
    return feeds_state.latest_states(spark, f"{root}/out").select("source", "visits", "skips", "errors", "status", "etag", F.unix_micros("due_at").alias("due_us"))


def _scratch(spark, label: str) -> str:
    return f"{shared_root(spark)}/vellum/{label}-{uuid.uuid4().hex}"


@query(_WITH_A + "select 'a,\"' || id || '\"' || chr(10) || 'b' as title, link as url, coalesce(category_id, '') as category, 'x,y' as tags, fetched_at as created, cast(favorited as varchar) as favourite from articles")
def csv_round_trip(spark, d):
    """SC8, SC10, SK1, SK3: commas, quotes and line feeds in cells, written and read again"""
    rows = articles(spark, d).select(F.concat(F.lit('a,"'), F.col("id"), F.lit('"\nb')).alias("title"), F.col("link").alias("url"), F.coalesce("category_id", F.lit("")).alias("category"), F.lit("x,y").alias("tags"), F.col("fetched_at").alias("created"), F.col("favorited").cast("string").alias("favourite"))
    path, n = tables.write_csv(rows, _scratch(spark, "csv"), "articles", NOW)
    if n != tables.validate_csv(spark, path, ARTICLE_CSV, ("url",), "url"):
        raise AssertionError("rows were lost")
    return tables.read_article_csv(spark, path, NOW)


def _feed_bodies(docs, kind):
    """(source, body): a feed of each source with the first 40 of its documents, in the syntax of its kind."""
    first = feeds.first_entries(docs, "source", "doc_id", 40).withColumn("kind", kind)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    link, lang, source, k = F.col("link"), F.col("lang"), F.col("source"), F.col("kind")
    rss = text("<item><link>", link, " </link><category>", lang, "</category><category>x</category></item>")
    atom = text("<entry><link rel='enclosure' href='https://e.com/no'/><link href='", link, "'/><category term='", lang, "'/><category term='x'/></entry>")
    rdf = text("<item><link>", link, "</link><dc:subject>", lang, "</dc:subject><dc:subject>x</dc:subject></item>")
    as_json = F.to_json(F.struct(link.alias("url"), F.array(lang, F.lit("x")).alias("tags")))
    item = F.when(k == 0, rss).when(k == 1, atom).when(k == 2, rdf).otherwise(as_json)
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"])  # 40 of them
    body = (
        F.when(k == 0, text("<rss version='2.0'><channel><title>", source, "</title>", F.array_join("items", ""), "</channel></rss>"))
        .when(k == 1, text("<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><title type='text'>", source, "</title>", F.array_join("items", ""), "</feed>"))
        .when(k == 2, text("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>", source, "</title></channel>", F.array_join("items", ""), "</rdf:RDF>"))
        .otherwise(text('{"version": "https://jsonfeed.org/version/1.1", "title": "', source, '", "items": [', F.array_join("items", ","), "]}"))
    )
    return first.groupBy("source", "kind").agg(items.alias("items")).select("source", body.alias("body"))


def _number(c="source"):
    return F.regexp_replace(c, "[^0-9]", "").cast("int")


@query("select source as title, cast(row_number() over (partition by source order by doc_id) - 1 as int) as place, 'https://e.com/' || cast(doc_id as varchar) as link, lang || '|x' as tags from documents where source is not null qualify row_number() over (partition by source order by doc_id) <= 30")
def feed_scan(spark, d):
    """SC11: a feed file for each source, RSS, Atom, RDF or JSON; its first 30 entries in document order"""
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source", "lang", F.concat(F.lit("https://e.com/"), F.col("doc_id").cast("string")).alias("link"))
    path = _scratch(spark, "feeds")
    _feed_bodies(docs, _number() % 4).select("source", F.col("body").alias("value")).write.partitionBy("source").text(path)
    read = tables.read_feeds(spark, f"{path}/source=*")
    entries = tables.feed_entries(read).join(read.select("feed", "title"), "feed")
    return entries.select("title", "place", "link", F.array_join("tags", "|").alias("tags"))


_SYNC_SQL = f"""with {SOURCES_SQL}, s as (select *, cast(regexp_replace(id, '[^0-9]', '', 'g') as int) as k from sources0),
v as (select *, case when k % 5 = 0 then 'status 500' when k % 5 = 1 then 'not a feed' when k % 7 = 6 then 'no answer' end as error, k % 5 > 1 and k % 7 = 3 as same from s where status in ('active', 'error')),
e as (select d.source, d.doc_id, row_number() over (partition by d.source order by d.doc_id) as place from documents d where d.source is not null),
f as (select e.*, 'https://example.org/new/' || cast(doc_id as varchar) as link from e join v on e.source = v.id where v.error is null and not v.same and place <= 30 and doc_id % 2 = 1),
n as (select source, count(*) as added from f group by 1) """


#: A readable end of a page that says when it was published.
_DATED = '<meta property="article:published_time" content="2021-05-06"><article><p>' + "a sentence, with a comma, that can be read. " * 12 + "</p></article>"


def _synced(spark, d):
    """Sources of which some are paused, fail, answer nonsense or have nothing new; half of the entries are stored."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.concat(F.lit("https://example.org/new/"), F.col("doc_id").cast("string")).alias("link"))
    stored = articles(spark, d).drop("content").withColumns({"link": F.concat(F.lit("https://example.org/new/"), F.substring("id", 2, 8).cast("int").cast("string")), "capture_failed": F.lit(False)}).where(F.substring("id", 2, 8).cast("int") % 2 == 0)
    state = sources(spark, d).where(~F.col("id").endswith("b")).withColumns({"name": F.col("feed_url"), "last_error": F.lit("old"), "last_synced_at": F.lit(None).cast("string"), "updated_at": F.col("created_at"), "feed_etag": F.lit("e0"), "feed_last_modified": F.lit(None).cast("string")})
    k = _number()
    fetched = _feed_bodies(docs.where("source is not null"), k % 4).join(state.select(F.col("id").alias("source"), "feed_url"), "source")
    fetched = fetched.select("feed_url", F.when(k % 5 == 0, 500).when((k % 5 > 1) & (k % 7 == 3), 304).otherwise(200).alias("status"), F.when(k % 5 == 1, "<html>no feed</html>").otherwise(F.col("body")).alias("body"), F.lit("e1").alias("etag"), F.lit("m1").alias("last_modified"), (k % 7 == 6).alias("lost"), (k % 5).alias("kind"))
    fetched = fetched.where("not (lost and kind > 1)").drop("lost", "kind")
    pages = docs.where("doc_id % 3 = 0").select(F.concat("link", F.lit("?utm_source=feed")).alias("url"), F.concat(F.lit("<title>page "), F.col("doc_id").cast("string"), F.lit("</title><body>x</body>"), F.when(F.col("doc_id") % 9 == 3, _DATED).otherwise("")).alias("html"))
    return feeds.sync_feeds(stored.withColumn("published_at", F.lit(None).cast("string")), state, fetched, pages, NOW), stored


@query(_SYNC_SQL + "select v.id, coalesce(n.added, 0) as added, v.error from v left join n on v.id = n.source")
def feed_sync(spark, d):
    """ST1, SC11: a sync of all sources; one that fails stops no other"""
    return _synced(spark, d)[0][2]


@query(_SYNC_SQL + "select s.id, case when v.id is null then s.status when v.error is null then 'active' else 'error' end as status, case when v.id is null then 'old' else v.error end as last_error, s.article_count + coalesce(n.added, 0) as article_count, case when v.id is not null and v.error is null and not v.same then s.id else s.feed_url end as name, case when v.id is not null and v.error is null and not v.same then 'e1' else 'e0' end as feed_etag, case when v.id is not null and v.error is null then '2024-06-01T00:00:00Z' end as last_synced_at from s left join v on s.id = v.id left join n on s.id = n.source")
def feed_sync_sources(spark, d):
    """ST1, D-15: what a sync leaves with each source"""
    return _synced(spark, d)[0][1].select("id", "status", "last_error", "article_count", "name", "feed_etag", "last_synced_at")


@query(_SYNC_SQL + "select link, source as source_id, doc_id % 3 <> 0 as capture_failed, case when doc_id % 3 = 0 then 'page ' || cast(doc_id as varchar) else 'example.org' end as title, case when doc_id % 3 = 0 and doc_id % 2 = 1 and doc_id % 9 = 3 then '2021-05-06' else '2024-06-01T00:00:00Z' end as published_at from f")
def feed_sync_articles(spark, d):
    """SC12, H14, D-1: entries that are new, those without a page as rows that say so; a time of publication is set where none is"""
    (after, _, _), stored = _synced(spark, d)
    return after.join(stored.select("id"), "id", "left_anti").select("link", "source_id", "capture_failed", "title", "published_at")


_IMPORT_SQL = f"""with {ARTICLES_SQL}, {CATEGORIES_SQL}, r as (select *, cast(substr(id, 2) as int) as line, cast(substr(id, 2) as int) % 10 = 0 as bad, cast(regexp_extract(link, '/([0-9]+)$', 1) as int) % 2 = 0 as there from articles),
s as (select * from r where reading_state = 'read'), b as (select *, row_number() over (partition by link order by line) as nth from r where not bad) """


def _import_input(spark, d):
    """Rows of a bookmark file, the articles there are, and fetched pages."""
    line = F.substring("id", 2, 8).cast("int")
    rows = articles(spark, d).select(line.alias("line"), "title", F.when(line % 10 == 0, "http://[bad").otherwise(F.concat("link", F.lit("?utm_source=x#top"))).alias("url"), F.when(F.col("category_id").isNull(), "Unsorted").otherwise(F.concat(F.lit(" "), F.col("category_id"))).alias("folder"), F.lit("A, b,,a").alias("tags"), F.col("fetched_at").alias("created"), F.lit("true").alias("favorite"))
    stored = articles(spark, d).drop("content").withColumn("capture_failed", F.lit(False)).where("reading_state = 'read'")
    pages = articles(spark, d).where(F.regexp_extract("link", "/([0-9]+)$", 1).cast("int") % 2 == 0).select(F.col("link").alias("url"), F.lit("<title>T</title><body>x</body>").alias("html"))
    return rows, stored, pages


def _imported(spark, d):
    rows, stored, pages = _import_input(spark, d)
    return imports.import_job(rows, stored, categories(spark), pages, NOW), stored


@query(_IMPORT_SQL + "select line, case when bad then 'failed' when link in (select link from s) then 'skipped' when line > (select min(line) from b where b.link = r.link) then 'skipped' when not there then 'failed' else 'imported' end as outcome from r")
def import_outcomes(spark, d):
    """ST4b, A8: what became of each row of an import"""
    return _imported(spark, d)[0][2].select("line", "outcome")


@query(_IMPORT_SQL + "select b.link, case when b.title = '' then case when there then 'T' else 'example.org' end else b.title end as title, 'a,b' as tags, true as favorited, not there as capture_failed, b.fetched_at, case when b.category_id is null then null else lower(b.category_id) end as folder from b where nth = 1 and link not in (select link from s)")
def import_articles(spark, d):
    """J12, M3 to M5, D-2: rows that an import adds, with their folder's category"""
    (after, known, _), stored = _imported(spark, d)
    named = known.select(F.col("id").alias("category_id"), F.lower("name").alias("folder"))
    new = after.join(stored.select("id"), "id", "left_anti").join(named, "category_id", "left")
    return new.select("link", "title", F.array_join("tags", ",").alias("tags"), "favorited", "capture_failed", "fetched_at", "folder")


@query(_IMPORT_SQL + "select id, case when link in (select link from b) then array_to_string(list_distinct_in_order, ',') else array_to_string(tags, ',') end as tags from (select *, list_concat(tags, list_filter(['a', 'b'], lambda t: not list_contains(tags, t))) as list_distinct_in_order from s)")
def import_top_ups(spark, d):
    """D-3 in an import: rows already there get the tags"""
    (after, _, _), stored = _imported(spark, d)
    return after.join(stored.select("id"), "id", "left_semi").select("id", F.array_join("tags", ",").alias("tags"))


@query(_IMPORT_SQL + """, w as (select line, case when bad then 'failed' when link in (select link from s) then 'skipped' when line > (select min(line) from b where b.link = r.link) then 'skipped' when not there then 'failed' else 'imported' end as outcome from r),
  m as (select min(line) as low, (max(line) - min(line) + 4) // 4 as n from r)
select ((line - low) // n)::int as batch, count(*) as total, count(*) filter (outcome = 'imported') as imported, count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'failed') as failed from w, m where (line - low) // n < 3 group by 1""")
def import_progress(spark, d):
    """ST4, A8: an import in four batches, cancelled after the third; what each one that landed came to"""
    rows, stored, pages = _import_input(spark, d)
    low, high = rows.agg(F.min("line"), F.max("line")).first()
    store = import_runs.open_library(spark, _scratch(spark, "import"), 64, stored.schema.toDDL().replace("`", ""), "id string, article_count bigint")
    store.commit({"articles": dedup.first_per_key(stored, "link", ["id"]), "categories": categories(spark)}, 0)
    watch = lambda batch, batches: import_runs.cancel(store, "x", NOW) if batch == 3 else None
    run = import_runs.ImportRun(store, "x", rows, pages, NOW, (high - low + 4) // 4, watch)
    if not run.run().first().cancelled:
        raise AssertionError("an import that was cancelled does not say so")
    return import_runs.progress(store, "x").select("batch", "total", "imported", "skipped", "failed")


@query("""with k as (select 'd/' || (doc_id % 7) || '/' || doc_id as key, doc_id from documents where doc_id % 3 = 0)
select key, 'deleted' as state from k where doc_id % 2 = 0 union all select key, 'left' from k where doc_id % 2 = 1 union all select 'd/none/' || doc_id, 'missing' from documents where doc_id % 50 = 1""")
def blob_deletes(spark, d):
    """SC13, J10: files, empty ones too, listed and deleted in executors, with what became of each key"""
    folder, n = _scratch(spark, "blobs").removeprefix("file:"), F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), (n % 7).cast("string"), F.lit("/"), n.cast("string")).alias("path"), F.when(n % 5 != 0, F.col("text")).alias("body"))
    tables.write_assets(docs.where("doc_id % 3 = 0"), folder)
    gone = docs.where("doc_id % 6 = 0").select(F.col("path").alias("key")).unionByName(docs.where("doc_id % 50 = 1").select(F.concat(F.lit("d/none/"), n.cast("string")).alias("key")))
    done = tables.delete_blobs(gone, folder)
    return done.select("key", F.col("outcome").alias("state")).unionByName(tables.list_blobs(spark, folder).select("key", F.lit("left").alias("state")))


@query("""with h as (select cast(doc_id as varchar) as doc_id, doc_id % 5 <> 0 as there, unnest([struct_pack(path := 'text', hash := sha256(coalesce(text, ''))), struct_pack(path := 'lang', hash := sha256(coalesce(lang, '')))]) as f from documents),
n as (select f.hash as hash, count(distinct doc_id) filter (there) as now, count(distinct doc_id) as ever from h group by 1)
select doc_id, f.path as path, now >= 2 as shared from h join n on h.f.hash = n.hash where there union all select 'deleted', hash, false from n where now = 0 and ever >= 2""")
def shared_blobs(spark, d):
    """A17, SK5, J10: contents of documents that come in two passes and partly go; shared ones by reference counts, dead ones swept"""
    docs, folder = table(spark, d, "documents"), _scratch(spark, "shared").removeprefix("file:")
    assets = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("path"), F.coalesce(F.col(c), F.lit("")).cast("binary").alias("body")) for c in ("text", "lang")))).alias("f")).select("doc_id", "f.*")
    store = blobs.open_blobs(spark, _scratch(spark, "blob-state"), 32)
    for left in (0, 1):
        blobs.put(store, folder, assets.where(F.col("doc_id") % 2 == left), f"2024-01-0{left + 1}T00:00:00Z")
    blobs.drop(store, docs.where("doc_id % 5 = 0"), "2024-01-03T00:00:00Z")
    swept = blobs.sweep(store, folder, _now()).where("outcome = 'deleted'").select(F.lit("deleted").alias("doc_id"), F.element_at(F.split("key", "/"), 3).alias("path"), F.lit(False).alias("shared"))
    return blobs.entries(store).select("doc_id", "path", F.col("key").isNotNull().alias("shared")).unionByName(swept)


@query(_WITH_A + """, f as (select * from (select *, row_number() over (partition by link order by id) as nth, cast(substr(id, 2) as int) as n from articles) where nth = 1 and n % 20 <> 7),
  t as (select source_id, category_id, list_distinct(list_concat(list_transform(tags, lambda x: case x when 'src4' then 'en' else x end), case when n % 6 = 0 then ['top'] else [] end)) as tags from f)
select 'source' as kind, source_id as name, count(*) as n from t where source_id is not null group by 2
union all select 'category', category_id, count(*) from t where category_id is not null group by 2
union all select 'tag', tag, count(*) from (select unnest(tags) as tag from t) where tag is not null group by 2""")
def kept_counters(spark, d):
    """A3, A4, A6: counters kept by signed deltas through inserts, a rename, top-ups and deletions, against the recount"""
    rows = articles(spark, d).select("id", "link", "source_id", "category_id", F.filter("tags", lambda t: t.isNotNull()).alias("tags"), "updated_at")
    n = F.substring("id", 2, 8).cast("int")
    store = edits.open_counted(spark, _scratch(spark, "counted"), 32, rows.schema.toDDL().replace("`", ""), "id string, article_count bigint, updated_at string")
    first = dedup.first_per_key(rows, "link", ["id"])
    for part in (n % 2 == 0, n % 2 == 1):
        edits.insert(store, first.where(part))
    edits.rename_tag(store, "src4", "en", NOW)
    edits.import_rows(store, first.where(n % 6 == 0).withColumn("tags", F.array(F.lit("Top "), F.lit("top"))), NOW)
    edits.delete(store, first.where(n % 20 == 7).select("id"), NOW)
    counters.folded(store)
    return counters.counters(store.read()["deltas"])


@query(_WITH_A + "select title, link as url, coalesce(category_id, '') as folder, 'x,y' as tags, fetched_at as created, cast(favorited as varchar) as favorite from articles where id not like '%3'")
def bookmark_file(spark, d):
    """SC7: a bookmark file with columns of its own; rows without an address are dropped"""
    rows = articles(spark, d).select(F.lit("9").alias("id"), F.col("title"), F.lit("n").alias("note"), F.when(F.col("id").endswith("3"), " ").otherwise(F.col("link")).alias("url"), F.coalesce("category_id", F.lit("")).alias("folder"), F.lit("x,y").alias("tags"), F.col("fetched_at").alias("created"), F.col("favorited").cast("string").alias("favorite"))
    path, _ = tables.write_csv(rows, _scratch(spark, "bookmarks"), "b", NOW)
    return tables.read_bookmarks(spark, path).drop("line")


@query(_WITH_S + "select feed_url from sources")
def feed_file(spark, d):
    """SC9, SK2: the feeds' own export read again"""
    rows = tables.source_rows(sources(spark, d).withColumn("last_synced_at", F.lit(None).cast("string")))
    path, _ = tables.write_csv(rows.unionByName(rows.limit(1).withColumn("feed_url", F.lit("  "))), _scratch(spark, "feeds"), "s", NOW)
    return tables.read_feed_urls(spark, path)


@query(_WITH_A + "select id, link, updated_at, cast(7 as bigint) as version from articles")
def manifest_round_trip(spark, d):
    """SC14: a manifest written and read again"""
    entries = sync.manifest_entries(articles(spark, d), "article", "fetched_at")
    path = _scratch(spark, "manifest")
    tables.write_manifest(entries, spark.createDataFrame([("article", "x", NOW)], "entity_type string, entity_id string, deleted_at string"), 7, path)
    read, dead, version = tables.read_manifest(spark, path, "id string, entity_type string, conflict_key string, updated_at string, created_at string, content_hash string", "entity_type string, entity_id string, deleted_at string")
    if dead.count() != 1:
        raise AssertionError("tombstones were lost")
    return read.select("id", F.col("conflict_key").alias("link"), "updated_at", F.lit(version).cast("long").alias("version"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)")
def applied_tombstones(spark, d):
    """D-18"""
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    gone = table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "article").otherwise("source").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id"))
    return mutate.apply_tombstones(rows, "article", gone).select("doc_id")


@query("select doc_id, case when doc_id % 2 = 0 then 'second' else 'first' end as version from documents")
def snapshot_commits(spark, d):
    """SC13: a conditional write publishes a version; one that lost the race is tried again"""
    docs = table(spark, d, "documents").select("doc_id")
    store = Store(spark, _scratch(spark, "store"), {"t": "doc_id long, version string"})
    store.commit({"t": docs.withColumn("version", F.lit("first"))}, 0)
    try:
        store.commit({"t": docs.withColumn("version", F.lit("late"))}, 0)
    except Conflict:
        store.update(lambda state: {"t": mutate.change(state["t"], F.col("doc_id") % 2 == 0, {"version": "second"})})
    return store.read()["t"]


@query(
    _WITH_A + """, b as (select item_id from benchmark), k as (select *, row_number() over (partition by link order by id) as n, cast(substr(id, 2) as bigint) as d from articles)
    select id, link, case when d % 40 = 3 then not favorited else favorited end as favorited,
      case when d % 40 = 3 then 'read' else reading_state end as reading_state, array_to_string(list_transform(tags, lambda t: case t when 'src3' then 'third' else t end), ',') as tags
    from k where n = 1 and d % 50 <> 6
    union all select 'n' || item_id, 'https://example.org/new/' || item_id, true, 'unread', '' from b"""
)
def bucket_commits(spark, d):
    """SC13, D-1, D-5, D-11, D-14: a chain of edits, each of which writes the buckets of its own keys"""
    columns = ("id", "link", "source_id", "tags", "favorited", "reading_state", "reading_progress", "updated_at")
    rows, none = articles(spark, d).select(*columns), spark.createDataFrame([], "id string, article_count long, updated_at string")
    store = edits.open_library(spark, _scratch(spark, "library"), 64, rows.schema.toDDL().replace("`", ""), none.schema.toDDL())
    store.commit({"articles": dedup.first_per_key(rows, "link", ["id"]), "sources": none}, 0)
    number = F.expr("cast(substr(id, 2) as bigint)")
    new = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("n"))
    fresh = new.select(F.concat(F.lit("n"), "n").alias("id"), F.concat(F.lit("https://example.org/new/"), "n").alias("link"), *(F.lit(None).cast(t).alias(c) for c, t in (("source_id", "string"), ("tags", "array<string>"))), F.lit(True).alias("favorited"), F.lit("unread").alias("reading_state"), F.lit(0.0).alias("reading_progress"), F.lit(NOW).alias("updated_at"))
    log = rows.where(number % 40 == 3).select("id", F.lit(NOW).alias("at"), F.lit("read").alias("reading_state"), (~F.col("favorited")).alias("favorited"), F.lit(None).cast("double").alias("reading_progress"))
    edits.apply_state_log(store, log)
    edits.rename_tag(store, "src3", "third", NOW)
    edits.delete(store, rows.where(number % 50 == 6).select("id"), NOW)
    edits.insert(store, fresh.withColumn("tags", F.array().cast("array<string>")))
    edits.insert(store, fresh.withColumn("tags", F.array(F.lit("again"))))
    return store.read()["articles"].select("id", "link", "favorited", "reading_state", F.array_join("tags", ",").alias("tags"))


@query("select page_id from pages where page_id % 3 <> 0 or page_id % 5 = 0")
def changed_feeds(spark, d):
    """ST3: only feeds with another validator than last time are work"""
    feeds = table(spark, d, "pages").select(F.col("page_id").alias("feed"), F.col("url").alias("validator"))
    seen = feeds.where("feed % 3 = 0").withColumn("validator", F.when(F.col("feed") % 5 == 0, "old").otherwise(F.col("validator")))
    return changed_sources(seen, feeds).select(F.col("feed").alias("page_id"))
