"""Keyed state of sources: replayed outcomes, due times, retention, restarts."""

import datetime
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vellum import queries
from vellum.streaming import sources

SF = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1)


def hours(n):
    return START + datetime.timedelta(hours=n)


def feed(spark, folder, *rows):
    full = [(s, hours(h), status, etag, None, error, interval) for s, h, status, etag, error, interval in rows]
    spark.createDataFrame(full, sources.OUTCOME).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def run(spark, tmp_path):
    folder, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def go(late="1 hour", keep_days=60):
        stream = spark.readStream.schema(sources.OUTCOME).option("maxFilesPerTrigger", 1).parquet(folder)
        sources.keep_states(sources.source_states(stream, late=late, keep_days=keep_days), out, ck).awaitTermination()
        return [r.asDict() for r in spark.read.schema(f"{sources.STATE}, batch long").parquet(out).orderBy("batch", "source", "kind", "due_at").collect()]

    go.folder, go.out = folder, out
    return go


def test_states_due_times_and_retention(spark, run):
    feed(spark, run.folder, ("a", 0, 200, "e1", None, 6), ("a", 1, 304, "zz", None, 6), ("b", 0, 500, None, "boom", 11), (None, 0, 200, "e", None, 6), ("c", None or 2, 200, "c1", None, None))
    run()
    states = {r["source"]: r for r in sources.latest_states(spark, run.out).toPandas().to_dict("records")}
    assert {k: (v["visits"], v["skips"], v["errors"], v["status"], v["etag"], v["last_error"], v["interval_hours"]) for k, v in states.items()} == {
        "a": (2, 1, 0, "active", "e1", None, 6), "b": (1, 0, 1, "error", None, "boom", 12), "c": (1, 0, 0, "active", "c1", None, 6),
    }
    assert states["a"]["due_at"].to_pydatetime() == hours(7) and states["b"]["due_at"].to_pydatetime() == hours(12)
    feed(spark, run.folder, ("b", 13, None, None, None, 12))
    said = run()
    due = {(r["source"], r["due_at"]) for r in said if r["kind"] == "due"}
    assert ("a", hours(7)) in due and ("c", hours(8)) in due
    b = next(r for r in sources.latest_states(spark, run.out).collect() if r.source == "b")
    assert (b.visits, b.errors, b.last_error, b.due_at) == (2, 2, "no answer", hours(25))
    feed(spark, run.folder, ("z", 24 * 90, 200, "z", None, 24))
    said = run()
    feed(spark, run.folder, ("z", 24 * 91, 304, "z", None, 24))
    run()
    feed(spark, run.folder, ("z", 24 * 92, 304, "z", None, 24), ("a", 24 * 92, 200, "again", None, 6))
    said = run()
    assert {r["source"] for r in said if r["kind"] == "forgotten"} == {"a", "b", "c"}
    again = next(r for r in sources.latest_states(spark, run.out).collect() if r.source == "a")
    assert (again.visits, again.etag) == (1, "again")


def test_a_restart_changes_nothing_and_batches_add_up(spark, run):
    for h in range(5):
        feed(spark, run.folder, ("a", h, 200 if h % 2 else 304, f"e{h}", None, 6), ("b", h, 500, None, None, 6))
    run(late="30 days")
    once = sorted(map(tuple, sources.latest_states(spark, run.out).collect()), key=str)
    run(late="30 days")  # nothing new: the checkpoint knows all files
    assert sorted(map(tuple, sources.latest_states(spark, run.out).collect()), key=str) == once
    assert {r[0]: r[2:5] for r in once} == {"a": (5, 3, 0), "b": (5, 0, 5)}


def test_the_clock_and_time_to_live(spark, run, tmp_path):
    feed(spark, run.folder, ("a", 0, 200, "e1", None, 24))
    stream = spark.readStream.schema(sources.OUTCOME).parquet(run.folder)
    query = sources.keep_states(sources.source_states(stream), run.out, str(tmp_path / "ck"), every="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            if list(Path(run.out).rglob("_SUCCESS")) and sources.latest_states(spark, run.out).count():
                break
    finally:
        query.stop()
    assert [(r.source, r.visits) for r in sources.latest_states(spark, run.out).collect()] == [("a", 1)]


def test_replay_query_takes_all_events(spark):
    out = queries.QUERIES["source_replay"](spark, SF)
    assert out.agg(F.sum("visits")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
