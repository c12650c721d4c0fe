"""Keyset pages over ranges of files, and title search by postings, against the plain ways."""

import random

from pyspark.sql import functions as F

from vellum.functions.text import contains_ascii_ci
from vellum.operators.filters import ArticleFilter
from vellum.operators.library import library_page
from vellum.plans import search
from vellum.sources import ranges

SF = "/root/testdata/sf0.1"


def test_a_page_in_the_middle_opens_few_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"), F.col("event_id").alias("id"), F.col("event_type").alias("title"), (F.col("value") > 20).alias("favorited"))
    folder = str(tmp_path / "ranges")
    ranges.write_ranges(events, folder, files=100)
    total = spark.read.parquet(f"{folder}/bounds").count()
    middle = events.where("id = 50000").first()
    for condition, limit in ((None, 60), (ArticleFilter(favorites=True), 40), (ArticleFilter(search="SIGN"), 25)):
        cursor = (middle.fetched_at, middle.id)
        page, opened = ranges.ranged_page(spark, folder, condition, limit, cursor)
        want = library_page(events, condition, limit, cursor)
        assert (page.rows, page.has_more, page.cursor) == (want.rows, want.has_more, want.cursor)
        assert len(opened) < 0.05 * total and total > 50
    nothing, opened = ranges.ranged_page(spark, folder, ArticleFilter(search="no such title"), 10)
    assert nothing.rows == [] and not nothing.has_more and len(opened) == total


def test_pages_follow_each_other_without_gaps(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-{1 + i % 3:02}", f"a{i:03}", i) for i in range(95)], "fetched_at string, id string, n int")
    folder = str(tmp_path / "ranges")
    ranges.write_ranges(rows, folder, files=8)
    seen, cursor = [], None
    while True:
        page, _ = ranges.ranged_page(spark, folder, None, 20, cursor)
        seen += page.rows
        if not page.has_more:
            break
        cursor = page.cursor
    assert seen == rows.orderBy(F.desc("fetched_at"), F.desc("id")).collect()
    empty = str(tmp_path / "empty")
    ranges.write_ranges(rows.limit(0), empty)
    assert ranges.ranged_page(spark, empty)[0].rows == []


ARTICLES = "link string, title string, n int"


def test_search_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    titles = [r.t for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("t")).collect()] + ["ÉTÉ à Paris", "été", "100% _sure_", None, "", "ab", "aaa aaa"]
    rows = spark.createDataFrame([(f"l{i}", t, i) for i, t in enumerate(titles)], ARTICLES)
    store = search.open_searchable(spark, str(tmp_path / "s"), 16, ARTICLES)
    search.load(store, rows)
    stored = rows.cache()
    needles = ["ÉT", "éTé", "% _", "AAA", "a", "", "zzzzqq", "  "] + [t[k : k + rng.randrange(1, 9)].swapcase() for t in rng.sample([x for x in titles if x and len(x) > 12], 192 // 8) for k in rng.sample(range(10), 1)]
    for needle in needles:
        want = sorted(r.link for r in (stored.where(contains_ascii_ci("title", needle.strip())) if needle.strip() else stored).collect())
        assert sorted(r.link for r in search.find(store, needle).collect()) == want, needle


def test_postings_change_with_the_state(spark, tmp_path):
    store = search.open_searchable(spark, str(tmp_path / "s"), 8, ARTICLES)
    frame = lambda *rows: spark.createDataFrame(list(rows), ARTICLES)
    search.load(store, frame(("a", "Hello world", 1), ("b", "other", 2), ("c", None, 3)))
    found = lambda needle: sorted(r.link for r in search.find(store, needle).collect())
    search.insert(store, frame(("a", "ignored title", 9), ("d", "hello again", 4)))
    assert found("HELLO") == ["a", "d"] and found("ignored") == []
    search.retitle(store, spark.createDataFrame([("a", "World of others"), ("nope", "x y z")], "link string, title string"))
    assert found("hello") == ["d"] and found("other") == ["a", "b"] and found("x y z") == []
    search.delete(store, spark.createDataFrame([("b",), ("d",), ("none",)], "link string"))
    assert found("other") == ["a"] and found("hello") == []
    state = store.read()
    assert sorted(map(tuple, state["postings"].collect())) == sorted(map(tuple, search.postings_of(state["articles"]).collect()))
    assert (state["articles"].count(), sorted(r.n for r in state["articles"].collect())) == (2, [1, 3])
