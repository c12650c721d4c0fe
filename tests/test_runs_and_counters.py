"""Imports in batches with progress and cancel; listing and deleting in executors; counters kept by deltas."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from vellum.operators import counters, mutate
from vellum.plans import edits, import_runs
from vellum.sources import tables

NOW = "2024-06-01T00:00:00Z"
ARTICLES = "id string, link string, title string, source_id string, source_type string, tags array<string>, favorited boolean, reading_state string, reading_progress double, category_id string, capture_failed boolean, fetched_at string, updated_at string"
SOURCES = "id string, article_count long, updated_at string"
ROWS = "line int, title string, url string, folder string, tags string, created string, favorite string"


def bookmarks(spark, n=23):
    rows = [(i, f"t{i}", "http://[bad" if i % 10 == 3 else f"https://e.com/{i % 19}?utm_source=x", "News" if i % 2 else "Unsorted", "a,b", NOW, "true") for i in range(n)]
    return spark.createDataFrame(rows, ROWS)


def pages(spark):
    return spark.createDataFrame([(f"https://e.com/{i}", "<title>T</title><body>x</body>") for i in range(0, 19, 2)], "url string, html string")


def library(spark, path):
    store = import_runs.open_library(spark, str(path), 8, ARTICLES, SOURCES)
    stored = [("s1", "https://e.com/5", "old", None, "direct", ["z"], False, "read", 0.0, None, False, NOW, NOW)]
    store.commit({"articles": spark.createDataFrame(stored, ARTICLES)}, 0)
    return store


def articles_of(store):
    return sorted((r.link, r.title, tuple(r.tags), r.category_id, r.capture_failed) for r in store.read()["articles"].collect())


def test_batches_add_up_and_are_taken_once(spark, tmp_path):
    store, seen = library(spark, tmp_path / "a"), []
    run = import_runs.ImportRun(store, "one", bookmarks(spark), pages(spark), NOW, 6, lambda b, n: seen.append((b, n)))
    got = run.run().first()
    assert seen == [(1, 4), (2, 4), (3, 4), (4, 4)]
    assert (got.total, got.processed, got.cancelled) == (23, 23, False) and got.imported + got.skipped + got.failed == 23
    lines = sorted(import_runs.progress(store, "one").select("batch", "total", "imported", "skipped", "failed").collect())
    assert [r.total for r in lines] == [6, 6, 6, 5] and sum(r.imported for r in lines) == got.imported
    whole = library(spark, tmp_path / "b")
    want = import_runs.ImportRun(whole, "one", bookmarks(spark), pages(spark), NOW, 1000).run().first()
    assert want == got and articles_of(whole) == articles_of(store)
    version = store.version()
    assert import_runs.ImportRun(store, "one", bookmarks(spark), pages(spark), NOW, 6).run().first() == got and store.version() == version
    nothing = import_runs.ImportRun(store, "none", bookmarks(spark).limit(0), pages(spark), NOW).run().first()
    assert (nothing.total, nothing.imported, nothing.cancelled) == (0, 0, False)


def test_a_cancelled_run_leaves_whole_batches_and_says_so(spark, tmp_path):
    store = library(spark, tmp_path / "a")
    watch = lambda batch, batches: import_runs.cancel(store, "two", NOW) if batch == 2 else None
    got = import_runs.ImportRun(store, "two", bookmarks(spark), pages(spark), NOW, 5, watch).run().first()
    assert (got.total, got.processed, got.cancelled) == (23, 10, True)
    lines = {r.batch: r.total for r in import_runs.progress(store, "two").collect()}
    assert lines == {0: 5, 1: 5}
    first = [r for r in bookmarks(spark).where("line < 10").collect() if r.url != "http://[bad"]
    assert {a[0] for a in articles_of(store)} == {r.url.split("?")[0] for r in first} | {"https://e.com/5"}


def test_stopping_gives_up_the_batch_under_way(spark, tmp_path, monkeypatch):
    store = library(spark, tmp_path / "a")
    slow = pages(spark).withColumn("html", F.concat("html", F.expr("cast(java_method('java.lang.Thread', 'sleep', cast(20000 as bigint)) as string)")))
    run = import_runs.ImportRun(store, "three", bookmarks(spark), slow, NOW, 100)
    timer = threading.Timer(6, run.stop, [NOW])
    timer.start()
    got = run.run().first()
    timer.join()
    assert (got.processed, got.cancelled) == (0, True) and len(articles_of(store)) == 1


def test_files_are_listed_and_deleted_in_executors(spark, tmp_path):
    root = tmp_path / "blobs"
    for name in ("top", "a/one", "a/b/two", "a/b/empty", "c.d/three", "c.d/.hidden", "a/b/.two.crc"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if name == "a/b/empty" else b"x")
    listed = lambda prefix="": sorted(r.key for r in tables.list_blobs(spark, str(root), prefix).collect())
    assert listed() == ["a/b/empty", "a/b/two", "a/one", "c.d/.hidden", "c.d/three", "top"]
    assert listed("a/b") == ["a/b/empty", "a/b/two"] and listed("a/b/t") == ["a/b/two"] and listed("no/such") == [] and listed("t") == ["top"]
    row = tables.list_blobs(spark, f"file://{root}", "top").first()
    assert row.key == "top" and row.last_modified.endswith("Z")
    keys = spark.createDataFrame([("a/b/empty",), ("a/b/empty",), ("top",), ("not/there",), ("../blobs/a/one",), (None,), ("",)], "key string")
    assert {r.key: r.outcome for r in tables.delete_blobs(keys, str(root), 2).collect()} == {"a/b/empty": "deleted", "top": "deleted", "not/there": "missing", "../blobs/a/one": "refused", "": "refused"}
    assert listed() == ["a/b/two", "a/one", "c.d/.hidden", "c.d/three"] and os.path.exists(root / "a/one")
    assert tables.delete_blobs(keys.limit(0), str(root)).count() == 0


def row(i, tags, source="s", category=None):
    return (f"a{i}", f"https://e.com/{i}", f"t{i}", source, "rss", tags, False, "unread", 0.0, category, False, NOW, NOW)


def same(store):
    kept = sorted(map(tuple, counters.counters(store.read()["deltas"]).collect()))
    assert kept == sorted(map(tuple, counters.counts(store.read()["articles"]).collect()))
    return {(k, n): c for k, n, c in kept}


def test_kept_counters_equal_the_recount(spark, tmp_path):
    store = edits.open_counted(spark, str(tmp_path / "lib"), 8, ARTICLES, SOURCES)
    store.commit({"sources": spark.createDataFrame([("s", 30, NOW)], SOURCES)}, 0)
    frame = lambda *rows: spark.createDataFrame(list(rows), ARTICLES)
    edits.insert(store, frame(*(row(i, ["x", "y"] if i % 2 else [], category="c" if i % 3 else None) for i in range(12)), row(50, None, None)))
    edits.insert(store, frame(row(0, ["never"])))
    edits.import_rows(store, frame(row(0, ["new", "x"]), row(90, ["new"], "t")), NOW)
    edits.rename_tag(store, "y", "x", NOW)
    assert ("tag", "y") not in same(store)
    edits.delete(store, spark.createDataFrame([("a1",), ("a2",), ("gone",)], "id string"), NOW)
    edits.delete_tag(store, "new", NOW)
    got = same(store)
    assert got["source", "s"] == 10 and got["source", "t"] == 1 and ("tag", "new") not in got
    rows = store.read()["deltas"].count()
    counters.folded(store)
    assert same(store) == got and store.read()["deltas"].count() == len(got) < rows
    edits.edit_where(store, F.col("id") == "a4", lambda a: mutate.change(a, F.col("id") == "a4", {"source_id": "t"}))
    assert same(store)["source", "t"] == 2
    log = spark.createDataFrame([("b", "tag", "t", 1), ("c", "tag", "t", -4)], counters.DELTAS)
    assert counters.counters(log).count() == 0


def test_counted_changes_do_not_wait_for_each_other(spark, tmp_path):
    store = edits.open_counted(spark, str(tmp_path / "lib"), 64, ARTICLES, SOURCES)
    store.commit({"articles": spark.createDataFrame([row(i, ["x"]) for i in range(20)], ARTICLES), "deltas": spark.createDataFrame([("b", "tag", "x", 20), ("b", "source", "s", 20)], counters.DELTAS)}, 0)
    buckets = {r[0]: r[1] for r in store.read()["articles"].select("link", store.bucket("articles", 64)).collect()}
    other = next(k for k, b in buckets.items() if b != buckets["https://e.com/0"])
    links = lambda x: spark.createDataFrame([(x,)], "link string")
    untag = lambda link: lambda a: mutate.change(a, F.col("link") == link, {"tags": F.array().cast("array<string>")})
    calls = []

    def mine(articles):
        calls.append(1)
        if len(calls) == 1:
            counters.counted_change(store, links(other), untag(other))
        return untag("https://e.com/0")(articles)

    counters.counted_change(store, links("https://e.com/0"), mine)
    assert same(store)["tag", "x"] == 18 and len(calls) <= 2
    with pytest.raises(KeyError):
        counters.counted_change(import_runs.open_library(spark, str(tmp_path / "other"), 8, ARTICLES, SOURCES), links("a"), mine)
