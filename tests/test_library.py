"""Behaviour over hand-made rows: paging, facets, mutations, conflicts, replication, stores and streams."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum import schemas
from vellum.operators import dedup, filters, library, mutate, sync
from vellum.plans import capture, imports
from vellum.sources import store, tables
from vellum.streaming import ingest

ROW = "id string, link string, title string, fetched_at string, updated_at string, tags array<string>, category_id string, source_id string, favorited boolean, reading_progress double, reading_state string"
T0 = "2024-01-01T00:00:00Z"
NOW = "2024-06-01T00:00:00Z"


def art(i, link=None, title="", at=T0, updated=T0, tags=(), category=None, source=None, fav=False, progress=0.0, state="unread"):
    return (i, link or f"https://e.com/{i}", title, at, updated, list(tags), category, source, fav, progress, state)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def test_pages_have_no_gaps_under_ties(spark):
    df = frame(spark, art("a"), art("b"), art("c"), art("z", at="2024-02-01T00:00:00Z"))
    first = library.library_page(df, None, 2)
    assert [r.id for r in first.rows] == ["z", "c"] and first.has_more
    second = library.library_page(df, None, 2, first.cursor)
    assert [r.id for r in second.rows] == ["b", "a"] and not second.has_more


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30)), unique_by=lambda x: x[1], min_size=1, max_size=12), st.integers(1, 4))
def test_pages_are_complete(spark, rows, limit):
    df = frame(spark, *[art(f"{i:03}", at=f"2024-01-0{d + 1}T00:00:00Z") for d, i in rows]).cache()
    got, cursor = [], None
    while True:
        page = library.library_page(df, None, limit, cursor)
        got += [r.id for r in page.rows]
        if not page.has_more:
            break
        cursor = page.cursor
    assert got == [f"{i:03}" for d, i in sorted(rows, key=lambda x: (x[0], f"{x[1]:03}"), reverse=True)]


def test_pushed_filters(spark, tmp_path):
    frame(spark, art("a")).write.parquet(str(tmp_path / "t"))
    df = library.page_query(spark.read.parquet(str(tmp_path / "t")).select("id", "fetched_at"), None, 5, ("2024", "b"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "TakeOrderedAndProject" in plan


def test_filters(spark):
    df = frame(spark, art("r", title="Batteries at 50% capacity", tags=("rust", "systems"), fav=True), art("j", title="x", tags=("javascript",), category="c"))
    ids = lambda **k: sorted(r.id for r in library.library_page(df, filters.ArticleFilter(**k)).rows)
    assert ids(favorites=True) == ["r"]
    assert ids(tags=("javascript", "systems")) == ["j", "r"]
    assert ids(category=schemas.UNCATEGORIZED) == ["r"]
    assert ids(search="BATTERIES") == ["r"] and ids(search="50% capacity") == ["r"] and ids(search="50x") == []
    assert ids(search="  ") == ["j", "r"]


def test_facets(spark):
    df = frame(spark, art("1", tags=("ai", "accessibility")), art("2", tags=("ai", "design")), art("3", tags=("unrelated",)))
    got = {r.tag: r.n for r in library.tag_counts(df, filters.ArticleFilter(tags=("ai",))).collect()}
    assert got == {"accessibility": 1, "ai": 2, "design": 1}


def test_rename_merges_and_counts(spark):
    df = frame(spark, art("1", tags=("a", "b")), art("2", tags=("b",)), art("3", tags=("c",)))
    got = {r.id: (r.tags, r.updated_at) for r in mutate.rename_tag(df, "a", "b", NOW).collect()}
    assert got == {"1": (["b"], NOW), "2": (["b"], T0), "3": (["c"], T0)}
    assert mutate.tagged(df, " B") == 2 and mutate.delete_tag(df, " C ", NOW).where("id = '3'").first().tags == []
    for old, new in ((" A ", "a"), ("a", "  "), ("", "b")):
        assert {r.updated_at for r in mutate.rename_tag(df, old, new, NOW).collect()} == {T0}


def test_first_of_a_key_does_not_depend_on_the_dealing(spark):
    rows = [art(f"{i:02}", link="l", title=str(i)) for i in range(30)]
    for seed in range(3):
        batch = frame(spark, *rows).repartition(5, F.xxhash64("id", F.lit(seed)))
        assert [r.id for r in mutate.insert_ignore(frame(spark), batch).collect()] == ["00"]
        assert [r.title for r in dedup.first_per_key(batch, "link", ["title"]).collect()] == ["0"]
    assert dedup.first_per_key(frame(spark), "link").count() == 0


def test_keys_that_are_missing_do_not_collide(spark):
    df = frame(spark, art("a", link="l"), art("b", link="l"), art("c"), art("d")).withColumns({"link": F.when(F.col("id").isin("a", "b"), F.col("link")).when(F.col("id") == "c", ""), "conflict_key": F.col("link"), "created_at": F.col("fetched_at")})
    df = df.unionByName(df.where("id in ('c', 'd')").withColumn("id", F.concat("id", F.lit("2")))).withColumn("conflict_key", F.col("link"))
    assert [(r.id, r.winner_id) for r in dedup.conflict_losers(df).collect()] == [("b", "a")]
    kept, losers = sync.resolve_articles(df, NOW)
    assert sorted(r.id for r in kept.collect()) == ["a", "c", "c2", "d", "d2"] and losers.count() == 1


def test_earliest_tombstone_is_an_instant(spark):
    rows = [("article", "x", "2024-01-01T02:00:00+02:00"), ("article", "x", "2024-01-01T01:00:00Z"), ("article", "y", "odd"), ("article", "y", "2020-01-01T00:00:00Z")]
    got = {r.entity_id: r.deleted_at for r in dedup.earliest_tombstones(spark.createDataFrame(rows, schemas.TOMBSTONES)).collect()}
    assert got == {"x": "2024-01-01T02:00:00+02:00", "y": "odd"}


def test_deletions_change_their_sources(spark):
    feeds = spark.createDataFrame([("s", "n", 3, T0), ("t", "n", 2, T0)], "id string, name string, article_count long, updated_at string")
    dead = spark.createDataFrame([], schemas.TOMBSTONES)
    df = frame(spark, art("a", source="s"), art("b", source="t"))
    one = mutate.delete_articles(df, feeds, dead, df.where("id = 'a'").select("id"), NOW)[1]
    assert {(r.id, r.article_count, r.updated_at) for r in one.collect()} == {("s", 2, NOW), ("t", 2, T0)}
    assert {(r.article_count, r.updated_at) for r in mutate.delete_all_articles(df, feeds, dead, NOW)[1].collect()} == {(0, NOW)}


def test_top_up_is_a_true_no_op(spark):
    df = frame(spark, art("1", link="l", tags=("a",)))
    batch = lambda tags: spark.createDataFrame([("l", tags)], "link string, tags array<string>")
    same = mutate.top_up_tags(df, batch(["a"]), NOW).first()
    more = mutate.top_up_tags(df, batch(["z", "a", "b"]), NOW).first()
    assert (same.tags, same.updated_at) == (["a"], T0)
    assert (more.tags, more.updated_at) == (["a", "z", "b"], NOW)


def test_insert_ignore_returns_stored_row(spark):
    df = frame(spark, art("old", link="l"))
    after, rows = mutate.insert_and_return(df, frame(spark, art("new", link="l"), art("n", link="m")))
    assert sorted(r.id for r in after.collect()) == ["n", "old"]
    assert sorted(r.id for r in rows.collect()) == ["n", "old"]


def test_categories(spark):
    cats = mutate.create_category(spark.createDataFrame([], schemas.CATEGORIES), "1", "News", T0)
    with pytest.raises(mutate.NameTaken):
        mutate.create_category(cats, "2", "nEWS ", T0)
    with pytest.raises(mutate.NameTaken):
        mutate.rename_category(mutate.create_category(cats, "2", "Émile", T0), "2", "news", T0)
    with pytest.raises(ValueError, match="no category"):
        mutate.assign_category(frame(spark, art("a")), cats, "a", "9", NOW)
    assert mutate.assign_category(frame(spark, art("a")), cats, "a", "1", NOW).first().category_id == "1"
    assert mutate.set_icon(cats, "1", "star", NOW).first().icon == "star"
    cats2, arts, dead = mutate.delete_category(cats, frame(spark, art("a", category="1")), spark.createDataFrame([], schemas.TOMBSTONES), "1", NOW)
    assert cats2.count() == 0 and arts.first().category_id is None and tuple(dead.first()) == ("category", "1", NOW)


def test_reader_state(spark):
    df = frame(spark, art("a"), art("b", state="read"))
    assert {r.id: r.reading_state for r in mutate.open_article(mutate.open_article(df, "a", NOW), "b", NOW).collect()} == {"a": "reading", "b": "read"}
    assert mutate.toggle_favorite(df, "a", NOW).where("id = 'a'").first().favorited
    assert mutate.save_progress(df, "a", 7.0, NOW).where("id = 'a'").first().reading_progress == 1.0


def test_overrides_change_all_five_and_no_time(spark):
    columns = ", ".join(f"{c} string" for c in mutate.OVERRIDES)
    df = spark.createDataFrame([("a", T0, *"12345"), ("b", T0, *"12345")], f"id string, updated_at string, {columns}")
    got = {r.id: tuple(r)[1:] for r in mutate.set_overrides(df, "a", {"font_override": "mono"}).collect()}
    assert got == {"a": (T0, None, None, None, None, "mono"), "b": (T0, *"12345")}


def test_remote_tombstones_keep_their_time(spark):
    mine = spark.createDataFrame([("article", "a", NOW), ("article", "b", NOW)], schemas.TOMBSTONES)
    theirs = spark.createDataFrame([("article", "a", T0), ("source", "a", T0)], schemas.TOMBSTONES)
    assert {tuple(r) for r in mutate.record_remote_tombstones(mine, theirs).collect()} == {("article", "a", T0), ("article", "b", NOW), ("source", "a", T0)}


def test_recapture_keeps_state(spark):
    columns = ", ".join(f"{c} string" for c in mutate.CONTENT)
    df = frame(spark, art("a", tags=("t",), progress=0.5)).drop("title").crossJoin(spark.createDataFrame([tuple("old" for _ in mutate.CONTENT)], columns))
    batch = spark.createDataFrame([("a", *("new" for _ in mutate.CONTENT))], f"id string, {columns}")
    row = mutate.recapture(df, batch, NOW).first()
    assert (row.title, row.content_html, row.tags, row.reading_progress, row.updated_at) == ("new", "new", ["t"], 0.5, NOW)


def test_sources(spark):
    rows = [("s", "https://f", "rss", "https://f", "active", None, 3, None, T0, T0, None, None), ("t", "T", "rss", "https://f", "active", None, 2, None, NOW, NOW, None, None)]
    df = spark.createDataFrame(rows, schemas.SOURCES)
    assert mutate.toggle_pause(df, "s", NOW).where("id = 's'").first().status == "paused"
    assert mutate.name_if_default(mutate.name_if_default(df, "s", "Feed"), "t", "Feed").orderBy("id").first().name == "Feed"
    assert mutate.set_feed_cache(df, "s", "e", None).where("id = 's'").first().feed_etag == "e"
    kept, moved = dedup.collapse_sources(df, frame(spark, art("a", source="s"), art("b")))
    assert [(r.id, r.article_count) for r in kept.collect()] == [("t", 5)]
    loose = df.withColumn("feed_url", F.lit(None).cast("string"))
    assert sorted((r.id, r.article_count) for r in dedup.collapse_sources(loose, frame(spark, art("a", source="s")))[0].collect()) == [("s", 3), ("t", 2)]
    assert {r.id: r.source_id for r in moved.collect()} == {"a": "t", "b": None}
    gone, arts, dead = mutate.remove_source(df, frame(spark, art("a", source="s")), spark.createDataFrame([], schemas.TOMBSTONES), "s", NOW)
    assert gone.count() == 1 and arts.first().source_id is None and dead.first().entity_id == "s"


def test_sightings_with_ledger(spark):
    entries = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "z"), (6, "z")], "n int, content_hash string")
    ledger = spark.createDataFrame([("y", False), ("z", True)], schemas.LEDGER)
    got = {r.n: r.action for r in dedup.sightings(entries, ledger, ["n"]).collect()}
    assert got == {1: "literal", 2: "promote", 3: "pointer", 4: "promote", 5: "pointer", 6: "pointer"}
    assert {r.content_hash: r.promoted for r in dedup.updated_ledger(entries, ledger).collect()} == {"x": True, "y": True, "z": True}


def _replica(spark, *rows, dead=()):
    empty_c, empty_s = spark.createDataFrame([], schemas.CATEGORIES), spark.createDataFrame([], schemas.SOURCES)
    return sync.Replica(frame(spark, *rows), empty_c, empty_s, spark.createDataFrame(list(dead), schemas.TOMBSTONES))


def _state(replica):
    return sorted((r.id, tuple(r.tags), r.favorited, r.reading_progress) for r in replica.articles.collect())


def test_replicas_converge(spark):
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    a = _replica(spark, art("art-a", link="l", at="2020-01-01T00:00:00Z", tags=("x",)), art("k", updated=NOW, progress=0.7), art("dead"), dead=[("article", "gone", "2024-05-30T00:00:00Z")])
    b = _replica(spark, art("art-b", link="l", at="2021-01-01T00:00:00Z", tags=("y",), fav=True), art("k", progress=0.1), art("gone"), dead=[("article", "dead", "2024-05-30T00:00:00Z"), ("article", "old", "2023-01-01T00:00:00Z"), ("article", "odd", "???")])
    one, _, report = sync.reconcile(a, b, now, NOW)
    two, _, _ = sync.reconcile(b, a, now, NOW)
    want = [("art-a", ("x", "y"), True, 0.0), ("k", (), False, 0.7)]
    assert _state(one) == want and _state(two) == want
    assert {r.entity_id for r in one.tombstones.collect()} == {"gone", "dead", "odd", "art-b"}
    assert {r.entity_type: (r.pulled, r.pushed, r.deleted, r.merged) for r in report.collect()}["article"] == (1, 2, 1, 1)
    again, _, quiet = sync.reconcile(one, one, now, NOW)
    assert _state(again) == want and all((r.pulled, r.pushed, r.deleted, r.merged) == (0, 0, 0, 0) for r in quiet.collect())


def test_store_retries_lost_races(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), {"t": "id string"})
    row = lambda x: spark.createDataFrame([(x,)], "id string")
    assert s.read()["t"].count() == 0
    raced = []

    def change(state):
        if not raced:
            raced.append(1)
            s.commit({"t": state["t"].unionByName(row("other"))}, s.version())
        return {"t": state["t"].unionByName(row("mine"))}

    assert s.update(change) == 2
    assert sorted(r.id for r in s.read()["t"].collect()) == ["mine", "other"]
    assert [r.id for r in s.read(1)["t"].collect()] == ["other"]
    with pytest.raises(store.Conflict):
        s.commit({}, 0)


def test_bookmark_csv(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('id,title,url,folder,tags,created,favorite\n1,"A ""q""\nline",https://e.com/a?utm_x=1,New folder,"x, y",2020-01-01,true\n2,,https://e.com/b,New folder,,2020,\n3,,https://e.com/c,Unsorted,,2020,\n4,, ,,,2020,\n')
    rows = tables.read_bookmarks(spark, str(path))
    assert rows.count() == 3 and rows.where("title <> ''").first().title == 'A "q"\nline'
    stored = spark.createDataFrame([("https://e.com/b",)], "link string")
    from vellum.functions.text import folder_key

    got = [tuple(r) for r in imports.preview(rows, stored, folder_key("folder")).collect()]
    assert got == [("Uncategorized", 1, 0), ("New folder", 2, 1)]
    assert tables.validate_csv(spark, str(path), schemas.BOOKMARK_CSV, ("url", "created"), "url") == 3
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(tables.BadCsv):
        tables.validate_csv(spark, str(tmp_path / "c.csv"), schemas.BOOKMARK_CSV, ("url",), "url")


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('A "q", b', "https://e.com/1", "News", "x,y", T0, "true"), ("", "https://e.com/2", "", "", T0, "false")], schemas.ARTICLE_CSV)
    path, n = tables.write_csv(rows, str(tmp_path), "articles", NOW)
    assert n == 2
    assert sorted(map(tuple, tables.read_article_csv(spark, path, NOW).collect())) == sorted(map(tuple, rows.collect()))


def test_feeds(spark, tmp_path):
    items = "".join(f"<item><title>t{i}</title><link> https://e.com/{i} </link><category>a</category><category>b</category></item>" for i in range(40))
    (tmp_path / "f.xml").write_text(f"<?xml version='1.0'?><rss version='2.0'><channel><title>F</title>{items}<item><title>no link</title></item></channel></rss>")
    entries = tables.feed_entries(tables.read_feeds(spark, str(tmp_path / "f.xml"))).orderBy("place").collect()
    assert len(entries) == 30 and entries[3].link == "https://e.com/3" and entries[0].tags == ["a", "b"]
    bodies = spark.createDataFrame([("<?xml version='1.0'?><feed xmlns='x'>",), ("<rss>",), ("\ufeff<!DOCTYPE x>\n<!-- a --><rdf:RDF>",), ('{"version": "https:\\/\\/jsonfeed.org\\/version\\/1"}',), ("<html><rss>",), (None,), ('{"a": 1}',), ("<feeding>",)], "body string")
    feeds, pages = tables.sniffed(bodies)
    assert feeds.count() == 4 and pages.count() == 4
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title>A</title><entry><link rel='self' href='https://e.com/self'/><link href='https://e.com/1'/></entry><entry><link rel='enclosure' href='https://e.com/2'/><category term='t'/></entry><entry><id>x</id></entry></feed>"
    bad = spark.createDataFrame([("a", atom), ("b", "<rss><channel><title>half"), ("c", "<rss/>"), ("d", None), ("e", "<feed></feed>")], "feed string, body string").select("feed", tables.parsed_feed("body").alias("f"))
    got = {r.feed: r.f for r in bad.collect()}
    assert [(i.link, i.tags) for i in got["a"].items] == [("https://e.com/1", []), ("https://e.com/2", ["t"]), (None, [])] and got["a"].title == "A"
    assert got["c"] is None and got["d"] is None and got["e"] is None


def test_a_feed_that_fails_stops_no_other(spark):
    now = NOW
    state = spark.createDataFrame([(i, f"https://f/{i}", "rss", f"https://f/{i}", s, None, 0, None, T0, T0, None, None) for i, s in (("good", "error"), ("bad", "active"), ("gone", "active"), ("same", "active"), ("off", "paused"))], schemas.SOURCES)
    body = "<rss><channel><title> Good </title><item><link>https://e.com/a?utm_x=1</link><category>Tag </category></item><item><link>https://e.com/b</link></item><item><link>https://e.com/old</link></item></channel></rss>"
    fetched = spark.createDataFrame([("https://f/good", 200, body, "e1", "m1"), ("https://f/bad", 200, "<html>", "x", "x"), ("https://f/same", 304, None, "y", "y"), ("https://f/off", 200, body, None, None)], "feed_url string, status int, body string, etag string, last_modified string")
    pages = spark.createDataFrame([("https://e.com/a", "<title>A</title><body><p>x</p></body>")], "url string, html string")
    stored = spark.createDataFrame([], schemas.ARTICLES).unionByName(frame(spark, art("o", link="https://e.com/old")), allowMissingColumns=True)
    from vellum.plans import feeds

    after, sources, report = feeds.sync_feeds(stored, state, fetched, pages, now)
    assert {(r.id, r.added, r.error) for r in report.collect()} == {("good", 2, None), ("bad", 0, "not a feed"), ("gone", 0, "no answer"), ("same", 0, None)}
    got = {r.link: r for r in after.collect()}
    assert set(got) == {"https://e.com/old", "https://e.com/a", "https://e.com/b"}
    assert (got["https://e.com/a"].title, got["https://e.com/a"].tags, got["https://e.com/a"].source_id, got["https://e.com/a"].capture_failed, got["https://e.com/a"].published_at) == ("A", ["tag"], "good", False, now)
    assert got["https://e.com/b"].capture_failed and got["https://e.com/b"].capture_error == "no page"
    rows = {r.id: r for r in sources.collect()}
    assert (rows["good"].name, rows["good"].status, rows["good"].feed_etag, rows["good"].article_count) == ("Good", "active", "e1", 2)
    assert (rows["bad"].status, rows["bad"].last_error, rows["bad"].feed_etag) == ("error", "not a feed", None) and rows["gone"].last_error == "no answer"
    assert (rows["same"].status, rows["same"].feed_etag) == ("active", None) and tuple(rows["off"]) == tuple(state.where("id = 'off'").first())
    again = feeds.sync_feeds(after, sources, fetched, pages, now)[2].collect()
    assert all(r.added == 0 for r in again)


def test_assets_and_listing(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.png", b"1"), ("c.SVG", b"<svg/>"), ("a/d", b"2"), ("e", None)], "path string, body binary")
    folder = str(tmp_path / "assets")
    (tmp_path / "assets").mkdir()
    (tmp_path / "assets" / "stale").write_text("x")
    assert tables.write_assets(rows, folder) == 4
    assert sorted(p.relative_to(folder).as_posix() for p in (tmp_path / "assets").rglob("*") if p.is_file()) == ["a/b.png", "a/d", "c.SVG", "e"]
    import gzip

    assert gzip.decompress((tmp_path / "assets" / "c.SVG").read_bytes()) == b"<svg/>"
    assert {r.key for r in tables.list_blobs(spark, folder, "a/").collect()} == {"a/b.png", "a/d"}
    with pytest.raises(Exception, match="not a path inside"):
        tables.write_assets(spark.createDataFrame([("../x", b"1")], "path string, body binary"), folder)


def test_manifest_codec(spark, tmp_path):
    entries = spark.createDataFrame([("a", "article", "l", T0, T0, "h")], schemas.MANIFEST)
    dead = spark.createDataFrame([("article", "x", T0)], schemas.TOMBSTONES)
    tables.write_manifest(entries, dead, 7, str(tmp_path / "m"))
    e, t, v = tables.read_manifest(spark, str(tmp_path / "m"), schemas.MANIFEST, schemas.TOMBSTONES)
    assert e.collect() == entries.collect() and t.collect() == dead.collect() and v == 7
    assert tables.write_manifest(entries.limit(0), dead, 8, str(tmp_path / "m"), base=1) == 2  # a second write to the path
    assert e.count() == 1 and tables.read_manifest(spark, str(tmp_path / "m"), schemas.MANIFEST, schemas.TOMBSTONES)[2] == 8
    with pytest.raises(store.Conflict):
        tables.write_manifest(entries, dead, 9, str(tmp_path / "m"), base=1)
    assert tables.read_manifest(spark, str(tmp_path / "none"), schemas.MANIFEST, schemas.TOMBSTONES)[2] == 0


@pytest.mark.parametrize("begin", ["<!-- a -->" * 100_000, "<!--" * 100_000, "<?x y?>\n" * 100_000, f"<!-- {'x' * 5_000_000} -->", "<?xml version='1.0'?><!DOCTYPE rss> "])
def test_long_prologues_of_feeds(spark, begin):
    import time

    body = f"{begin}<rss version='2.0'><channel><title>T</title><item><link>l</link></item></channel></rss>"
    rows = spark.createDataFrame([(body,)], "body string")
    began = time.perf_counter()
    got = rows.select(tables.feed_kind("body").alias("kind"), tables.parsed_feed("body").alias("feed")).first()
    assert time.perf_counter() - began < 20
    assert got.kind == (None if begin.startswith("<!--<!--") else "rss")
    assert tables.root_of(body) == got.kind


def test_tag_text_takes_linear_time(spark):
    import time

    from vellum.functions.text import tag_text

    rows = spark.createDataFrame([("<title>" * 140_000,)], "html string")
    began = time.perf_counter()
    assert rows.select(tag_text("html", "title").alias("t")).first().t is None
    assert time.perf_counter() - began < 10


def test_blobs(spark):
    rows = frame(spark, art("a", tags=("x",)))
    blobs = tables.row_blobs(rows, "article")
    assert blobs.first().key == "sync/blobs/articles/a/meta.json.gz"
    bad = spark.createDataFrame([("k", b"junk")], "key string, body binary")
    assert tables.rows_of_blobs(blobs.unionByName(bad), ROW).collect() == rows.collect()


def test_capture(spark):
    good = "<html><head><title>T</title></head><body><article><p>" + "word " * 300 + "</p><p>x</p><img src='/i.png' onload=x></article></body></html>"
    pages = spark.createDataFrame([("https://e.com/a?utm_source=1", good), ("https://e.com/a", good), ("https://e.com/b", None), ("bad", good), ("https://e.com/old", good), ("https://e.com/thin", "<title>Q</title><body>hello</body>")], "url string, html string")
    stored = spark.createDataFrame([("https://e.com/old",)], "link string")
    got = {r.link: r for r in capture.capture(capture.new_pages(pages, stored), NOW).collect()}
    assert set(got) == {"https://e.com/a", "https://e.com/b", "bad", "https://e.com/thin"}
    a = got["https://e.com/a"]
    assert (a.title, a.extraction_confident, a.capture_failed, a.assets, a.hero_url) == ("T", True, False, ["https://e.com/i.png"], "https://e.com/i.png")
    assert "onload" not in a.content_html and a.read_time_min == 1
    assert got["https://e.com/b"].capture_failed and got["https://e.com/b"].title == "e.com" and got["https://e.com/b"].read_time_min == 0
    assert got["bad"].capture_error == "invalid URL"
    assert (got["https://e.com/thin"].title, got["https://e.com/thin"].extraction_confident, got["https://e.com/thin"].excerpt) == ("Q", False, "hello")
    kept = spark.createDataFrame([("https://e.com/a", "https://e.com/i.png", "content/a/i.png")], "link string, url string, path string")
    local = capture.localize(capture.capture(pages.limit(1), NOW), kept).first()
    assert "content/a/i.png" in local.content_html


def test_stream(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), {"articles": "link string, n int"})
    folder = str(tmp_path / "in")
    write = lambda *links: spark.createDataFrame([(x, i) for i, x in enumerate(links)], "link string, n int").coalesce(1).write.mode("append").parquet(folder)
    run = lambda: ingest.ingest(ingest.page_stream(spark, folder, "link string, n int", 1), s, str(tmp_path / "ck"), lambda b: b).awaitTermination(60)
    write("a", "b", "a")
    run()
    write("b", "c")
    run()
    assert sorted(r.link for r in s.read()["articles"].collect()) == ["a", "b", "c"]


def test_seen_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("a", datetime.datetime(2024, 1, 2)), ("b", datetime.datetime(2024, 1, 1))], "link string, at timestamp").coalesce(1).write.parquet(folder)
    stream = ingest.seen_once(spark.readStream.schema("link string, at timestamp").parquet(folder), "link", "at")
    query = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 2
    seen = spark.createDataFrame([("f", "1"), ("g", "1")], "feed string, validator string")
    listing = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", "1")], "feed string, validator string")
    assert {r.feed for r in ingest.changed_sources(seen, listing).collect()} == {"g", "h"}


def test_jobs():
    from vellum.plans.jobs import Jobs

    jobs = Jobs()
    jobs.start("1", "u")
    jobs.start("2", "v")
    jobs.failed("1", "boom")
    assert [(j.job_id, j.state, j.error) for j in jobs.all()] == [("1", "failed", "boom"), ("2", "running", None)]
    assert jobs.retry("2") is None and jobs.retry("1").state == "running" and not jobs.dismiss("1")
    jobs.cancel("2")
    jobs.failed("2", "stopped")
    jobs.done("1")
    assert jobs.all() == [] and jobs.cancelled("2")
