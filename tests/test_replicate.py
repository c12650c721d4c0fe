"""Digest trees, and passes between two stores: what is read, what is published, and lost races."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from vellum import queries
from vellum.operators import digest, mutate
from vellum.plans import replicate
from vellum.sources.store import Conflict

SF = "/root/testdata/sf0.001"
NOW = "2024-06-01T00:00:00Z"
ARTICLES = "id string, link string, source_id string, category_id string, tags array<string>, favorited boolean, reading_progress double, fetched_at string, updated_at string"
SOURCES = "id string, name string, feed_url string, article_count bigint, created_at string, updated_at string"


def now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


def row(i, at="2024-01-01T00:00:00Z", link=None, category=None, favorited=False):
    return (f"a{i}", link or f"https://e.com/{i}", "s", category, [], favorited, 0.0, "2023-01-01T00:00:00Z", at)


def replica(spark, path, rows, categories=(("c", "News"),), stones=(), buckets=128):
    store = replicate.open_replica(spark, str(path), buckets, ARTICLES, SOURCES)
    named = spark.createDataFrame([(i, n, "folder", f"2024-01-0{k + 1}T00:00:00Z", NOW) for k, (i, n) in enumerate(categories)], "id string, name string, icon string, created_at string, updated_at string")
    dead = spark.createDataFrame([("article", i, "2024-05-30T00:00:00Z") for i in stones], "entity_type string, entity_id string, deleted_at string")
    store.commit({"articles": spark.createDataFrame(rows, ARTICLES), "categories": named, "tombstones": dead}, 0)
    return store


def state(store):
    return sorted((r.id, r.link, r.favorited, r.category_id) for r in store.read()["articles"].collect())


def counts(report):
    return {r.entity_type: (r.pulled, r.pushed, r.deleted, r.merged) for r in report.collect()}


@pytest.mark.parametrize("count", [1, 7, 64, 300])
def test_differing_finds_exactly_the_buckets_that_differ(spark, count):
    rng = random.Random(count)
    rows = [(f"k{i}", rng.randrange(5)) for i in range(400)]
    other = dict(rows)
    for k in rng.sample(sorted(other), 6):
        other[k] = -1 if rng.random() < 0.5 else other.pop(k)
    frames = [spark.createDataFrame([(k, v) for k, v in x if v is not None], "id string, v int") for x in (rows, other.items())]
    one, two = (digest.leaves(f, count, ("id", "v")) for f in frames)
    bucket = {r[0]: r[1] for r in frames[0].select("id", digest.bucket_of("id", count)).collect()}
    want = {bucket[k] for k, v in rows if other.get(k) != v}
    assert digest.differing(one, two, count) == sorted(want) and digest.differing(one, one, count) == []
    assert digest.differing(one, one.limit(0), count) == sorted(set(bucket.values()))


def test_a_pass_reads_only_what_differs(spark, tmp_path, monkeypatch):
    rows = [row(i) for i in range(3000)]
    one, two = replica(spark, tmp_path / "a", rows), replica(spark, tmp_path / "b", rows)
    assert counts(replicate.replicate(one, two, now(), NOW)) == {"category": (0, 0, 0, 0)}
    quiet = one.version(), two.version()
    one.change({"articles": spark.createDataFrame([("a5",)], "id string")}, lambda s: {"articles": mutate.toggle_favorite(s["articles"], "a5", "2024-02-01T00:00:00Z")})
    touched = one.bucket_count("articles")
    bucket = one.buckets_of("articles", spark.createDataFrame([("a5",)], "id string"), touched)
    for s in (one, two):  # the files of all other buckets may as well be gone
        for b, folder in s.record(s.version())["articles"]["at"].items():
            if int(b) not in bucket:
                shutil.rmtree(f"{folder}/_bucket={b}")
    seen, read = [], type(one).read_buckets
    monkeypatch.setattr(type(one), "read_buckets", lambda self, t, buckets, v=None: (seen.append(list(buckets)), read(self, t, buckets, v))[1])
    whole = type(one)._read  # a plan over all buckets is made, but not run: its files are gone
    monkeypatch.setattr(type(one), "_read", lambda self, record, t, buckets=None: whole(self, record, t, bucket if t == "articles" and buckets is None else buckets))
    assert counts(replicate.replicate(one, two, now(), NOW))["article"] == (0, 1, 0, 0)
    assert seen and all(set(x) <= set(bucket) for x in seen)
    assert two.read_buckets("articles", bucket).where("id = 'a5'").first().favorited and two.version() > quiet[1]


def test_both_sides_converge(spark, tmp_path):
    later = "2024-03-01T00:00:00Z"
    one = replica(spark, tmp_path / "a", [*(row(i) for i in range(60)), row(100, favorited=True, link="https://e.com/x"), row(7000, category="d")][3:], [("c", "News"), ("d", "Old")], stones=["a20"])
    two = replica(spark, tmp_path / "b", [*(row(i, later if i == 9 else "2024-01-01T00:00:00Z") for i in range(58)), row(200, link="https://e.com/x"), row(7001, category="e")], [("c", "News"), ("e", "OLD")], stones=["a30"])
    got = counts(replicate.replicate(one, two, now(), NOW))
    assert got["article"] == (3 + 1 + 2, 2 + 2, 2, 1) and got["category"] == (1, 1, 0, 1)
    assert state(one) == state(two)
    ids = {r[0] for r in state(one)}
    assert {"a20", "a30", "a200"}.isdisjoint(ids) and {"a100", "a0", "a59"} <= ids
    assert {r[3] for r in state(one)} == {None, "d"}
    versions = one.version(), two.version()
    assert all(set(v) == {0} for v in counts(replicate.replicate(one, two, now(), NOW)).values()) and (one.version(), two.version()) == versions


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    one, two = replica(spark, tmp_path / "a", [row(1), row(2)]), replica(spark, tmp_path / "b", [row(1)])
    publish, raced = replicate._publish, []

    def late(store, base, nodes, tables):
        if not raced:
            raced.append(1)
            two.change({"articles": spark.createDataFrame([("a9",)], "id string")}, lambda s: {"articles": s["articles"].unionByName(spark.createDataFrame([row(9)], ARTICLES))})
        return publish(store, base, nodes, tables)

    monkeypatch.setattr(replicate, "_publish", late)
    assert counts(replicate.replicate(one, two, now(), NOW))["article"] == (1, 1, 0, 0)
    assert state(one) == state(two) and len(state(one)) == 3

    def never(store, base, nodes, tables):
        raise Conflict("always")

    monkeypatch.setattr(replicate, "_publish", never)
    with pytest.raises(Conflict):
        replicate.replicate(one, two, now(), NOW)
    other = replica(spark, tmp_path / "c", [row(1)], buckets=32)
    with pytest.raises(ValueError, match="numbers of buckets"):
        replicate.replicate(one, other, now(), NOW)


def test_queries_name_what_they_cover(spark):
    assert queries.QUERIES["digest_replication"](spark, SF).count() == 3
