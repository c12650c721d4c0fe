"""Shared folders, table access and Arrow buffers for the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import importable, shared_root

MAX_ID = (1 << 63) - 1
#: JVM to Python batches are cut at this many bytes, so that long texts cannot pile up in a worker.
BATCH_BYTES = 4 << 20


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/vellum/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Let workers import this package, and cut batches at BATCH_BYTES. Spark reads that setting of the session only when a
    plan is run, after the operator has returned, so it stays; a smaller one is left alone."""
    importable(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text has this remainder; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus == remainder, F.lit(False))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows on end, and the n + 1 offsets of the rows; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    n = len(array)
    _, ends, data = array.buffers()
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer; offsets has a place for each row and one for the end."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data, np.uint8).tobytes())]
    )


def spans_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans, one span after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    heads = np.cumsum(n) - n
    out[heads] = np.concatenate([s[:1], s[1:] - (s[:-1] + n[:-1] - 1)])
    return np.cumsum(out)


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key of which one value may have a large share of the rows on the left.

    Where the right side was aggregated by the key, Spark would reuse that dealing and could not split its
    partitions. Joined by a one-to-one image of the key, both sides are dealt for the join alone, and AQE splits.
    """
    image = F.reverse(key) if dict(left.dtypes)[key] == "string" else F.bitwise_not(F.col(key))
    return left.withColumn("_image", image).join(right.withColumn("_image", image).drop(key), "_image").drop("_image")


def quoted(name: str) -> Column:
    """A column by its name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, docs: DataFrame) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def kept_texts(docs: DataFrame, kept: DataFrame, digest: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose (id, text_sha256) is in kept (one row a pair, null ids included), each pair once.

    digest: text_sha256 of a row of docs. Of rows with one pair the longest text stays, then the one whose JSON has the smallest
    digest, so columns may be of any type, maps too. Repeated ids are looked for in the id column alone; only rows of such ids are dealt again.
    """
    sha = free_name("_sha", docs)
    pairs = kept.select(F.col(id_col).alias("_kept"), F.col("text_sha256").alias("_kept_sha"))
    marked = docs.withColumn(sha, digest)
    found = marked.join(pairs, marked[id_col].eqNullSafe(pairs["_kept"]) & (marked[sha] == pairs["_kept_sha"]), "left_semi")
    columns = [quoted(c) for c in docs.columns]
    counts = docs.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again")
    if not counts.limit(1).count():
        return found.select(columns)
    same = found[id_col].eqNullSafe(counts["_again"])
    once, again = found.join(counts, same, "left_anti"), found.join(counts, same, "left_semi")
    place = free_name("_place", docs)
    size = -F.length(F.coalesce(quoted(text_col).cast("string"), F.lit("")))
    placed = saved(again.withColumn(place, F.monotonically_increasing_id()), "repeated-ids")  # written, so that a row keeps its place
    order = F.struct(size, F.sha2(F.to_json(F.struct(*columns)), 256), quoted(place).alias("place"))  # JSON, as maps have no order
    first = placed.groupBy(quoted(id_col).alias("_pair_id"), quoted(sha).alias("_pair_sha")).agg(F.min(order)["place"].alias(place))
    return once.select(columns).unionByName(placed.join(first.select(quoted(place)), place, "left_semi").select(columns))
