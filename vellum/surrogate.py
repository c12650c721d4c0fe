"""The test tables in the shape of a library, and the same in SQL.

Documents are articles, their languages categories and their sources feeds; versions, times and states follow
from the ids by arithmetic, so that both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.shared import importable

NOW = "2024-06-01T00:00:00Z"
_START = 1_704_067_200  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("a"), F.lpad(d.cast("string"), 8, "0")).alias("id"),
        F.col("source").alias("source_id"),
        F.when(d % 4 == 0, "direct").otherwise("rss").alias("source_type"),
        F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("title"),
        F.concat(F.lit("https://example.org/"), F.coalesce("lang", F.lit("-")), F.lit("/"), F.floor(d / 3).cast("string")).alias("link"),
        stamp(F.lit(_START) + (d * 7919 % 5000) * 60).alias("fetched_at"),
        F.element_at(F.array(F.lit("unread"), F.lit("reading"), F.lit("read")), (d % 3 + 1).cast("int")).alias("reading_state"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("favorited"),
        ((d % 11) / 10.0).alias("reading_progress"),
        F.array("lang", "source").alias("tags"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("category_id"),
        stamp(F.lit(_START) + (d * 6211 % 9000) * 60).alias("updated_at"),
        F.col("text").alias("content"),
    )


ARTICLES_SQL = f"""articles as (
  select 'a' || lpad(cast(d.doc_id as varchar), 8, '0') as id, source as source_id,
    case when d.doc_id % 4 = 0 then 'direct' else 'rss' end as source_type,
    substr(coalesce(text, ''), 1, 40) as title,
    'https://example.org/' || coalesce(lang, '-') || '/' || cast(d.doc_id // 3 as varchar) as link,
    strftime(make_timestamp(({_START} + (d.doc_id * 7919 % 5000) * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as fetched_at,
    case d.doc_id % 3 when 0 then 'unread' when 1 then 'reading' else 'read' end as reading_state,
    coalesce(quality, 0) = 1 as favorited, (d.doc_id % 11) / 10.0::double as reading_progress, [lang, source] as tags,
    case when lang <> 'es' then lang end as category_id,
    strftime(make_timestamp(({_START} + (d.doc_id * 6211 % 9000) * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as updated_at,
    text as content
  from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l on d.doc_id = l.doc_id
)"""

_NAMES = (("de", "German"), ("en", "English"), ("fr", "french"), ("xx", "Empty"), ("yy", "Éclair"))


def categories(spark: SparkSession) -> DataFrame:
    rows = [(i, n, "folder", f"2024-01-0{k + 1}T00:00:00Z", f"2024-01-0{k + 1}T00:00:00Z") for k, (i, n) in enumerate(_NAMES)]
    return spark.createDataFrame(rows, "id string, name string, icon string, created_at string, updated_at string")


CATEGORIES_SQL = "categories(id, name, icon, created_at, updated_at) as (values " + ", ".join(f"('{i}', '{n}', 'folder', '2024-01-0{k + 1}T00:00:00Z', '2024-01-0{k + 1}T00:00:00Z')" for k, (i, n) in enumerate(_NAMES)) + ")"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source a name, and a second one with the same feed for every third."""
    names = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("article_count"))
    number = F.regexp_replace("source", "[^0-9]", "").cast("int")
    first = names.select(F.col("source").alias("id"), F.upper("source").alias("name"), F.lit("rss").alias("type"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/feed")).alias("feed_url"), F.element_at(F.array(F.lit("active"), F.lit("paused"), F.lit("error")), number % 3 + 1).alias("status"), "article_count", stamp(F.lit(_START) + number * 3600).alias("created_at"))
    second = first.where(F.regexp_replace("id", "[^0-9]", "").cast("int") % 3 == 0).withColumns({"id": F.concat("id", F.lit("b")), "created_at": F.lit("2024-03-01T00:00:00Z"), "article_count": F.lit(1).cast("long")})
    return first.unionByName(second)


SOURCES_SQL = f"""sources0 as (
  select source as id, upper(source) as name, 'rss' as type, 'https://' || source || '.example.org/feed' as feed_url,
    case cast(regexp_replace(source, '[^0-9]', '', 'g') as int) % 3 when 0 then 'active' when 1 then 'paused' else 'error' end as status,
    count(*) as article_count,
    strftime(make_timestamp(({_START} + cast(regexp_replace(source, '[^0-9]', '', 'g') as bigint) * 3600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as created_at
  from documents where source is not null group by source
), sources as (
  select * from sources0 union all
  select id || 'b', name, type, feed_url, status, 1, '2024-03-01T00:00:00Z' from sources0 where cast(regexp_replace(id, '[^0-9]', '', 'g') as int) % 3 = 0
)"""


def replica_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two replicas that saw different events of the same users."""
    events = table(spark, sf_dir, "events")
    last = lambda keep: events.where(keep).groupBy(F.col("user_id").cast("string").alias("id")).agg(F.date_format(F.max("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))
    return last(F.col("event_id") % 3 != 0), last(F.col("event_id") % 5 != 0)


VERSIONS_SQL = """l as (select cast(user_id as varchar) as id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') as updated_at from events where event_id % 3 <> 0 group by 1),
r as (select cast(user_id as varchar) as id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') as updated_at from events where event_id % 5 <> 0 group by 1)"""
