"""Shared blobs with reference counts: contents that several documents hold are stored once, and go when nothing holds them.

A document's files are its holdings (path and content hash), in buckets of the document. Storing or deleting documents logs signed references by
content in the same version. A content that a second document comes to hold is promoted: its bytes are written under its hash, unless they are
there, which is safe to do twice as equal names have equal bytes. A sweep takes the contents whose references add up to nothing since before the
grace, from the log alone: no folder is listed. A content that is held again before its sweep stays; a sweep is not to run beside a put, which might
find a file that is about to go.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import past_grace
from ..sources.shared import cut
from ..sources.store import BUCKETS, Store
from ..sources.tables import delete_blobs, store_of

HOLDINGS = "doc_id string, path string, content_hash string"
REFERENCES = "batch string, content_hash string, n bigint, at string"


def open_blobs(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, path, {"holdings": HOLDINGS, "references": REFERENCES}, {"holdings": "doc_id", "references": "batch"}, buckets)


def blob_name(content_hash: Column) -> Column:
    return F.concat(F.lit("shared/"), F.substring(content_hash, 1, 2), F.lit("/"), content_hash)


def references(store: Store) -> DataFrame:
    """(content_hash, n, at): documents that hold each content, and when that last changed."""
    return store.read()["references"].groupBy("content_hash").agg(F.sum("n").alias("n"), F.max("at").alias("at"))


def _held(holdings: DataFrame, sign: int) -> DataFrame:
    """A signed reference for each document and content."""
    return holdings.select("doc_id", "content_hash").distinct().select("content_hash", F.lit(sign).cast("long").alias("n"))


def _replace(store: Store, docs: DataFrame, new: DataFrame, now: str) -> int:
    """The holdings of some documents become others, and the log gets the difference."""
    batch = uuid.uuid4().hex

    def change(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        old = state["holdings"].join(docs, "doc_id", "left_semi")
        moved = _held(new, 1).unionByName(_held(old, -1)).groupBy("content_hash").agg(F.sum("n").alias("n")).where("n <> 0")
        logged = moved.select(F.lit(batch).alias("batch"), "content_hash", "n", F.lit(now).alias("at"))
        return {"holdings": state["holdings"].join(docs, "doc_id", "left_anti").unionByName(new), "references": state["references"].unionByName(logged)}

    return store.change({"holdings": docs, "references": store.spark.createDataFrame([(batch,)], "batch string")}, change)


def _written(folder: str):
    def run(batches):
        files, base = store_of(folder)
        for batch in batches:
            done = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = f"{base}/{name}"
                there = files.get_file_info(target).type != fs.FileType.NotFound
                if not there:
                    files.create_dir(target.rpartition("/")[0], recursive=True)
                    draft = f"{target}.{uuid.uuid4().hex}"
                    with files.open_output_stream(draft) as out:
                        out.write(body.as_py() or b"")
                    files.move(draft, target)
                done.append(not there)
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "created": pa.array(done, pa.bool_())})

    return run


def put(store: Store, folder: str, assets: DataFrame, now: str) -> DataFrame:
    """Store whole documents (doc_id, path, body); (key, created) of the blobs that are shared now. The bytes of a content that one
    document holds stay with its bundle; null bodies are empty."""
    hashed = cut(assets.select(F.col("doc_id").cast("string").alias("doc_id"), "path", F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body")).withColumn("content_hash", F.sha2("body", 256)))
    _replace(store, hashed.select("doc_id").distinct(), hashed.select("doc_id", "path", "content_hash"), now)
    shared = references(store).where("n >= 2").select("content_hash")
    first = hashed.groupBy("content_hash").agg(F.first("body").alias("body"))  # equal bytes
    rows = first.join(shared, "content_hash", "left_semi").select(blob_name(F.col("content_hash")).alias("key"), "body")
    return cut(rows.mapInArrow(_written(folder), "key string, created boolean"))


def drop(store: Store, docs: DataFrame, now: str) -> int:
    """Documents go, and their references with them."""
    gone = cut(docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct())
    return _replace(store, gone, store.spark.createDataFrame([], HOLDINGS), now)


def entries(store: Store) -> DataFrame:
    """Holdings with the shared blob that each resolves to; null where the document has the only copy."""
    shared = references(store).where("n >= 2").select("content_hash", blob_name(F.col("content_hash")).alias("key"))
    return store.read()["holdings"].join(shared, "content_hash", "left").select("doc_id", "path", "content_hash", "key")


def sweep(store: Store, folder: str, now: Column) -> DataFrame:
    """Delete the blobs that nothing has held since before the grace: (key, outcome). Their log rows go first, and only if none has come
    meanwhile, so a content that is held again is written again."""
    state = references(store)
    dead = cut(state.where((F.col("n") <= 0) & past_grace("at", now)).select("content_hash"))
    if not dead.limit(1).count():
        return delete_blobs(dead.select(blob_name(F.col("content_hash")).alias("key")), folder)
    base = store.version()
    log = store.read(base)["references"]
    still = cut(log.join(dead, "content_hash", "left_semi").groupBy("content_hash").agg(F.sum("n").alias("n")).where("n <= 0").select("content_hash"))
    store.commit({"references": log.join(still, "content_hash", "left_anti")}, base)
    return delete_blobs(still.select(blob_name(F.col("content_hash")).alias("key")), folder)
