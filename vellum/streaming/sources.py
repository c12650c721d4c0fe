"""Sources with a state of their own: when each is due, what its validators are, how its visits went, and when it is forgotten.

A stream of fetch outcomes goes by source through one stateful operator. Each source keeps a value state that folds its outcomes in the order of
their times, and a timer: when a source falls due (6, 12 or 24 hours after its last visit) the operator says so, again after each further
interval, until an outcome comes. A source that nothing was heard of for `keep_days` is forgotten: by a time to live where times are
the clock's, by its timer where they are the events'.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import nearest
from ..sources.shared import importable

#: A visit: status is the HTTP status, or null where the fetch itself failed.
OUTCOME = "source string, at timestamp, status int, etag string, last_modified string, error string, interval_hours int"
_FACTS = "status string, visits long, skips long, errors long, etag string, last_modified string, last_error string, synced_at timestamp, seen_at timestamp, due_at timestamp, interval_hours int"
#: kind: state after a batch with outcomes of the source, due, or forgotten.
STATE = f"source string, kind string, {_FACTS}"
KEEP_DAYS = 60
_NAMES = [part.split()[0] for part in _FACTS.split(", ")]
_EMPTY = dict.fromkeys(_NAMES) | {"visits": 0, "skips": 0, "errors": 0}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def fold(state: dict, outcome: Row) -> dict:
    """The state of a source after one more visit: 304 is a skip, 2xx brings validators, all else is an error that leaves them alone."""
    new = state | {"visits": state["visits"] + 1, "seen_at": outcome["at"], "interval_hours": outcome.interval_hours}
    if outcome.status == 304:
        new |= {"skips": state["skips"] + 1, "status": "active", "last_error": None, "synced_at": outcome["at"]}
    elif outcome.status is not None and 200 <= outcome.status < 300:
        new |= {"status": "active", "last_error": None, "synced_at": outcome["at"], "etag": outcome.etag, "last_modified": outcome.last_modified}
    else:
        new |= {"errors": state["errors"] + 1, "status": "error", "last_error": outcome.error or (f"HTTP {outcome.status}" if outcome.status else "no answer")}
    return new | {"due_at": outcome["at"] + datetime.timedelta(hours=outcome.interval_hours)}


def _order(outcome: Row) -> tuple:
    """Outcomes by time; those of one time in a fixed order."""
    return outcome["at"], outcome.status or 0, outcome.etag or "", outcome.last_modified or "", outcome.error or "", outcome.interval_hours


def _millis(at: datetime.datetime) -> int:
    return int(at.timestamp() * 1000)


class SourceState(StatefulProcessor):
    """One source's outcomes and timers."""

    def __init__(self, event_time: bool, keep_days: int):
        self.event_time, self.keep_days = event_time, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keep = None if self.event_time else self.keep_days * 86_400_000
        self.state = handle.getValueState("source", _FACTS, keep) if keep else handle.getValueState("source", _FACTS)

    def _said(self, key: tuple, kind: str, state: dict) -> Row:
        return Row(source=key[0], kind=kind, **state)

    def _timer(self, at: datetime.datetime) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(_millis(at))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = dict(zip(_NAMES, self.state.get(), strict=True)) if self.state.exists() else dict(_EMPTY)
        for outcome in sorted(rows, key=_order):
            state = fold(state, outcome)
        self.state.update(tuple(state[n] for n in _NAMES))
        self._timer(state["due_at"])
        yield self._said(key, "state", state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        state = dict(zip(_NAMES, self.state.get(), strict=True))
        at = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        now = datetime.datetime.fromtimestamp((timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()) / 1000)
        end = state["seen_at"] + datetime.timedelta(days=self.keep_days)
        if self.event_time and max(at, now) >= end:
            self.state.clear()
            yield self._said(key, "forgotten", state)
            return
        each = datetime.timedelta(hours=state["interval_hours"])
        again = at + each * (max(datetime.timedelta(0), now - at) // each + 1)  # intervals that have gone by meanwhile are one
        self.handle.registerTimer(_millis(min(again, end) if self.event_time else again))
        yield self._said(key, "due", state | {"due_at": at})

    def close(self) -> None:
        pass


def source_states(outcomes: DataFrame, *, late: str | None = None, keep_days: int = KEEP_DAYS) -> DataFrame:
    """A stream of STATE rows from a stream of outcomes; intervals are snapped to 6, 12 or 24 hours, outcomes without a source or a time
    left out. late: how far behind the watermark is; times are then the events', and the clock's without it."""
    importable(outcomes.sparkSession)
    rows = outcomes.where("source is not null and at is not null").withColumn("interval_hours", nearest(F.coalesce("interval_hours", F.lit(6))).cast("int"))
    if late:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("source").transformWithState(SourceState(late is not None, keep_days), STATE, "update", "eventTime" if late else "processingTime")


def keep_states(states: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write what each batch says into a folder of its own, so that a batch that runs again replaces itself. Without `every`, all that
    is there is taken and the query ends; where times are the clock's it needs `every`, as timers keep it running."""
    spark = states.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = states.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the one with timers
    try:  # a query keeps the settings it was started with
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each source that keep_states has written."""
    said = spark.read.schema(f"{STATE}, batch long").parquet(folder).where("kind = 'state'")
    last = said.groupBy("source").agg(F.max_by(F.struct(*_NAMES), F.struct("batch", "visits")).alias("_s"))
    return last.select("source", *(F.col("_s")[n].alias(n) for n in _NAMES))
