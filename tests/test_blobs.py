"""Shared blobs: what is promoted, what a sweep takes, and the same live set as a full listing gives."""

from pyspark.sql import functions as F

from vellum.plans import blobs
from vellum.sources import tables

ASSETS = "doc_id string, path string, body binary"


def at(text):
    return F.to_timestamp(F.lit(text))


def test_three_passes_with_deletes_between(spark, tmp_path):
    store, folder = blobs.open_blobs(spark, str(tmp_path / "s"), 8), str(tmp_path / "files")
    (tmp_path / "files").mkdir()
    frame = lambda *rows: spark.createDataFrame([(d, p, b) for d, p, b in rows], ASSETS)
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id string")
    listed = lambda: sorted(r.key for r in tables.list_blobs(spark, folder).collect())

    def live():
        held = store.read()["holdings"].groupBy("content_hash").agg(F.count_distinct("doc_id").alias("n")).where("n >= 2")
        return sorted(r.key for r in held.select(blobs.blob_name(F.col("content_hash")).alias("key")).collect())

    first = blobs.put(store, folder, frame(("a", "1", b"x"), ("a", "2", b"x"), ("b", "1", b"x"), ("b", "2", b"only b"), ("c", "1", None)), "2024-01-01T00:00:00Z")
    assert [r.created for r in first.collect()] == [True] and listed() == live() and len(live()) == 1
    again = blobs.put(store, folder, frame(("d", "1", b"x"), ("d", "2", b"only b"), ("e", "1", b"")), "2024-01-02T00:00:00Z")
    assert sorted(r.created for r in again.collect()) == [False, True, True] and listed() == live() and len(live()) == 3
    assert {(r.doc_id, r.path) for r in blobs.entries(store).where("key is null").collect()} == set()
    blobs.drop(store, docs("a", "b", "d", "nobody"), "2024-01-03T00:00:00Z")
    n = {r.content_hash: r.n for r in blobs.references(store).collect()}
    assert sorted(n.values()) == [0, 0, 2]
    assert blobs.sweep(store, folder, at("2024-01-03 00:30:00")).count() == 0 and len(listed()) == 3  # in their grace
    blobs.put(store, folder, frame(("f", "1", b"only b")), "2024-01-03T00:40:00Z")  # held again before the sweep
    swept = blobs.sweep(store, folder, at("2024-01-04 00:00:00")).collect()
    assert [r.outcome for r in swept] == ["deleted"] and len(listed()) == 2 and set(live()) <= set(listed())
    back = blobs.put(store, folder, frame(("g", "1", b"x"), ("h", "1", b"x"), ("f", "1", b"changed")), "2024-01-05T00:00:00Z")
    assert [r.created for r in back.collect()] == [True]
    blobs.sweep(store, folder, at("2024-01-06 00:00:00"))
    assert listed() == live() and {(r.doc_id, r.path) for r in blobs.entries(store).where("key is not null").collect()} == {("c", "1"), ("e", "1"), ("g", "1"), ("h", "1")}
    assert blobs.sweep(store, folder, at("2025-01-01 00:00:00")).count() == 0
    assert blobs.put(store, folder, frame(("z", "1", b"q")).limit(0), "2025-01-01T00:00:00Z").count() == 0
