"""Incremental ingestion: new feed or page files flow into the snapshot store, each link once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutate import insert_ignore
from ..sources.shared import cut
from ..sources.store import Store


def seen_once(stream: DataFrame, key: str, event_time: str, keep: str = "60 days") -> DataFrame:
    """First row of each key; state older than `keep` behind the watermark is dropped."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, keep)
    return timed.dropDuplicatesWithinWatermark([key])


def changed_sources(seen: DataFrame, listing: DataFrame) -> DataFrame:
    """Feeds whose validator differs from the one of the last visit; the others need no work."""
    old = seen.select("feed", F.col("validator").alias("_old"))
    return listing.join(old, "feed", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("validator"))).drop("_old")


def ingest(stream: DataFrame, store: Store, checkpoint: str, make_rows: Callable[[DataFrame], DataFrame], table: str = "articles", every: str | None = None) -> StreamingQuery:
    """Insert the rows of each micro-batch unless their link is stored. Of a table with a key, a batch reads and writes the buckets of its
    own keys; a table without one is written anew. Sending a batch twice changes nothing, so the stream may restart anywhere. Without
    `every`, all that is there is taken and the query ends."""

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = cut(make_rows(batch))  # pages are parsed once, however often a race is lost
        if table in store.keys:
            store.change({table: rows}, lambda state: {table: insert_ignore(state[table], rows, store.keys[table])})
        else:
            store.update(lambda state: {table: insert_ignore(state[table], rows)})

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def page_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
