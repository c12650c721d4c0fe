"""Imports in batches that can be watched and cancelled.

The rows of a file are dealt to batches in their order and written out once. Each batch is one version of the store: its articles, in the
buckets of its links, its categories and its line of progress come together or not at all, so a run that ends anywhere leaves
whole batches, and one that starts again passes over those that are there. Cancelling leaves a mark that is looked for between
batches; the batch under way ends as it would, or is given up at once, with its Spark jobs, if that is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ARTICLES, SOURCES
from ..sources.shared import cut
from ..sources.store import BUCKETS, Store
from . import edits
from .imports import import_job, import_links

PROGRESS = "import_id string, batch int, total bigint, imported bigint, skipped bigint, failed bigint, at string"
MARKS = "import_id string, at string"
#: Rows of a batch.
BATCH_ROWS = 100


def open_library(spark: SparkSession, path: str, buckets: int = BUCKETS, articles: str = ARTICLES, sources: str = SOURCES) -> Store:
    """A library with tables for the progress of imports and for those that were cancelled."""
    return edits.open_library(spark, path, buckets, articles, sources, {"progress": PROGRESS, "cancelled": MARKS})


def cancel(store: Store, import_id: str, now: str) -> None:
    """No further batch of the import begins, wherever it runs; whatever has landed stays."""
    mark = store.spark.createDataFrame([(import_id, now)], MARKS)
    store.update(lambda state: {"cancelled": state["cancelled"].unionByName(mark)})


def is_cancelled(store: Store, import_id: str) -> bool:
    return bool(store.read()["cancelled"].where(F.col("import_id") == import_id).limit(1).count())


def progress(store: Store, import_id: str) -> DataFrame:
    """A row for each batch that has landed."""
    return store.read()["progress"].where(F.col("import_id") == import_id)


def summary(store: Store, import_id: str, total: int) -> DataFrame:
    """Sums of the batches that have landed, of how many rows there are, and whether the import was cancelled before its end."""
    sums = progress(store, import_id).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("imported", "skipped", "failed")), F.coalesce(F.sum("total"), F.lit(0)).alias("processed"))
    return sums.select(F.lit(total).cast("bigint").alias("total"), "processed", "imported", "skipped", "failed", (F.lit(is_cancelled(store, import_id)) & (F.col("processed") < total)).alias("cancelled"))


@dataclass
class ImportRun:
    """rows: a bookmark file with `line`, its order. pages: (url, html) of what was fetched. watch: told (batch, batches) after each batch."""

    store: Store
    import_id: str
    rows: DataFrame
    pages: DataFrame
    now: str
    batch_rows: int = BATCH_ROWS
    watch: Callable[[int, int], None] = lambda batch, batches: None
    total: int = field(init=False, default=0)

    def run(self) -> DataFrame:
        """The summary, once all batches have landed or the import was cancelled."""
        context = self.store.spark.sparkContext
        lines = cut(self.rows.where("trim(url) <> ''"))
        low, high, self.total = lines.agg(F.coalesce(F.min("line"), F.lit(0)), F.coalesce(F.max("line"), F.lit(-1)), F.count(F.lit(1))).first()
        batches = -(-(high - low + 1) // self.batch_rows)
        context.addJobTag(self.tag)
        try:
            for batch in range(batches):
                if is_cancelled(self.store, self.import_id):
                    break
                start = low + batch * self.batch_rows
                try:
                    self._land(batch, lines.where((F.col("line") >= start) & (F.col("line") < start + self.batch_rows)))
                except Exception:
                    if is_cancelled(self.store, self.import_id):  # its jobs were stopped, or it would have been the last anyway
                        break
                    raise
                self.watch(batch + 1, batches)
        finally:
            context.removeJobTag(self.tag)
        return summary(self.store, self.import_id, self.total)

    @property
    def tag(self) -> str:
        return f"import-{self.import_id}"

    def stop(self, now: str) -> None:
        """Cancel, and give up the batch under way."""
        cancel(self.store, self.import_id, now)
        self.store.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _land(self, batch: int, rows: DataFrame) -> None:
        if progress(self.store, self.import_id).where(F.col("batch") == batch).limit(1).count():
            return
        links = cut(import_links(rows).where("link is not null").select("link"))
        n = lambda what: F.count_if(F.col("outcome") == what).alias(what)

        def change(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
            articles, categories, done = import_job(rows, state["articles"], state["categories"], self.pages, self.now)
            line = done.agg(F.lit(self.import_id).alias("import_id"), F.lit(batch).alias("batch"), F.count(F.lit(1)).alias("total"), n("imported"), n("skipped"), n("failed"), F.lit(self.now).alias("at"))
            return {"articles": articles, "categories": categories, "progress": state["progress"].unionByName(line)}

        if links.limit(1).count():
            self.store.change({"articles": links}, change, reads=("categories", "progress"))
        else:  # nothing but addresses that do not parse
            self.store.update(lambda state: {"progress": change(state)["progress"]})
