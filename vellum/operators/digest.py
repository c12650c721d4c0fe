"""Digests of a table by ranges of a hash, as a tree: two replicas are compared from the root down, so what they share is not read.

A leaf is a bucket of the ids' hash, as the store keeps it, with the number, the sum and the exclusive or of the hashes of its rows; a
node above sums up FAN leaves or nodes. A leaf says which file it was made from, so a changed bucket is told from its record
alone, and only such leaves are made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store, bucket_of

FAN_BITS = 4
#: A leaf as a table of the store.
DIGESTS = "bucket int, place string, n long, total long, mixed long"
_FACTS = ("n", "total", "mixed")


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def leaves(rows: DataFrame, count: int, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """bucket, n, total (of 24 bits of each hash, which no number of rows here overflows) and mixed, of the buckets that have rows."""
    hashed = rows.select(bucket_of(key, count).alias("bucket"), row_hash(*columns).alias("h"))
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(F.lit((1 << 24) - 1))).alias("total"), F.bit_xor("h").alias("mixed"))


def levels(count: int) -> int:
    """Levels below the root."""
    return -(-max(0, (count - 1).bit_length()) // FAN_BITS)


def level_of(leaf_rows: DataFrame, level: int, count: int) -> DataFrame:
    """The nodes of a level (0 is the root), from the leaves."""
    node = F.shiftright("bucket", FAN_BITS * (levels(count) - level))
    return leaf_rows.groupBy(node.alias("node")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"))


def differing(one: DataFrame, other: DataFrame, count: int) -> list[int]:
    """Buckets in which two tables of leaves differ, found level by level below the nodes that differ. `count` numbers at most."""
    spark, nodes = one.sparkSession, [0]
    for level in range(levels(count) + 1):
        if level:
            above = F.broadcast(spark.createDataFrame([(n,) for n in nodes], "above int"))  # nodes of one level
            below = F.shiftright("bucket", FAN_BITS * (levels(count) - level + 1))
            here, there = (x.join(above, below == F.col("above"), "left_semi") for x in (one, other))
        else:
            here, there = one, other
        a, b = (level_of(x, level, count).select("node", F.struct(*_FACTS).alias(name)) for x, name in ((here, "_a"), (there, "_b")))
        nodes = sorted(r[0] for r in a.join(b, "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node").collect())
        if not nodes:
            return []
    return nodes


def current(store: Store, table: str, columns: tuple[str, ...], version: int, digests: str = "digests") -> DataFrame:
    """The leaves of a version: those in its digest table that were made from the files it has, the others anew."""
    entry = store.record(version).get(table)
    spark, at = store.spark, entry["at"] if isinstance(entry, dict) else {}
    now = spark.createDataFrame([(int(b), f) for b, f in at.items()], "bucket int, place string")  # a row a bucket
    kept = store.read(version)[digests].join(F.broadcast(now), ["bucket", "place"], "left_semi")
    stale = [r.bucket for r in now.join(kept.select("bucket"), "bucket", "left_anti").collect()]
    if not stale:
        return kept
    made = leaves(store.read_buckets(table, stale, version), store.bucket_count(table, version), columns, store.keys[table])
    return kept.unionByName(made.join(F.broadcast(now), "bucket").select(*kept.columns))
