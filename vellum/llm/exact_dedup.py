"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when identical after deleting ASCII white space (space, tab to carriage return).
A directory over the top bits of a 64-bit key doubles wherever a bucket holds more bytes than its
capacity, until the bucket fits or the histogram's resolution ends; the rest chains inside the bucket.
Owner tasks get whole buckets in key order, chain entries of equal keys and compare their bytes, and
write the index to the shared folder. A reading task sends a text's bytes once; copies that it meets later
travel as ids and lengths under the number of the first (the texts last seen are held, up to RECENT_BYTES).
Classes of over RESOLVE_AT members are resolved by a join of ids, never in one task.

Defined cases: a null text counts as empty; empty texts equal each other; a null id sorts last among
ties; of repeated rows (same id, same text) exactly one is kept; a text of any length is one entry, so it must fit
in a worker a few times over; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved

SPACE = b" \t\n\x0b\x0c\r"
#: Compressed bytes a bucket may hold before it is split, and that an owner task gets.
BUCKET_BYTES, OWNER_BYTES = 8 << 20, 8 << 20
#: Bits of the histogram: it has at most 2**20 rows, whatever the input.
BITS = 20
#: Classes of up to this many members are resolved where their chain ends.
RESOLVE_AT = 2048
#: Compressed bytes of texts that a reading task remembers as sent.
RECENT_BYTES = 8 << 20
#: Rows of a record batch that goes to the JVM.
_ROWS = 4096

_ENTRY = "bucket int, key long, task int, seq int, size long, packed binary, sha binary, ids binary, points binary"
_INDEX = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, key long, chain int, kind string, points long"
_ENTRY_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_INDEX_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE)


def _key(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def build_directory(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket number of each prefix; sizes: bytes under each of 2**bits prefixes.

    Starts with one bucket; a bucket over capacity splits, and the directory doubles when the bucket was
    as deep as the directory, up to the histogram's resolution.
    """
    bits = len(sizes).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    directory, depths, depth = np.zeros(1, np.int32), [0], 0
    todo = [(0, 0)]  # bucket, its prefix at its own depth
    while todo:
        bucket, prefix = todo.pop()
        d = depths[bucket]
        lo, hi = prefix << (bits - d), (prefix + 1) << (bits - d)
        if total[hi] - total[lo] <= capacity or d == bits:
            continue
        if d == depth:
            directory = np.repeat(directory, 2)
            depth += 1
        new = len(depths)
        depths[bucket] = d + 1
        depths.append(d + 1)
        first = (2 * prefix + 1) << (depth - d - 1)
        directory[first : first + (1 << (depth - d - 1))] = new
        todo += [(bucket, 2 * prefix), (new, 2 * prefix + 1)]
    return np.repeat(directory, 1 << (bits - depth))


def _histogram(batches):
    total: dict[int, int] = {}
    for batch in batches:
        for text in batch.column(0):
            data = normalised(text.as_py())
            prefix = _key(data) >> (64 - BITS)
            total[prefix] = total.get(prefix, 0) + len(data) // 3 + 64
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["prefix", "size"])


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _entries(directory: np.ndarray):
    """Entries of each batch's distinct texts. Ids go with the text's length in code points, as -1 - length where the id is null."""

    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        squeeze = zstandard.ZstdCompressor(level=1)
        sent: OrderedDict[tuple[int, int, bytes], int] = OrderedDict()
        number = held = 0
        for batch in batches:
            found: dict[tuple[int, int, bytes], tuple[list, list, bytes]] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                data = normalised(text)
                # equal texts have equal packed bytes; unequal ones never do
                ids, points, _ = found.setdefault((_key(data), len(data), squeeze.compress(data)), ([], [], hashlib.sha256(data).digest()))
                ids.append(0 if doc_id is None else doc_id)
                points.append(-1 - len(text) if doc_id is None else len(text))
            rows = []
            for name, (ids, points, sha) in found.items():
                key, size, packed = name
                if (seq := sent.get(name)) is None:
                    seq = sent[name] = number
                    number, held = number + 1, held + len(packed)
                else:
                    sent.move_to_end(name)
                    packed = None
                rows.append((int(directory[key >> (64 - BITS)]), key - (1 << 63), task, seq, size, packed, sha, np.array(ids, "<i8").tobytes(), np.array(points, "<i4").tobytes()))
            while held > RECENT_BYTES:
                held -= len(sent.popitem(last=False)[0][2])
            yield _batch(rows, _ENTRY_KINDS, _ENTRY)

    return run


class _Chain:
    """One class of equal texts under a key; members beyond RESOLVE_AT are sent on unresolved."""

    def __init__(self, number: int, size: int, packed: bytes, sha: bytes):
        self.number, self.size, self.packed, self.sha = number, size, packed, sha.hex()
        self.members: list[tuple[int, bool, int]] = []  # as they compete: -length, whether the id is null, id
        self.count, self.best, self.claimed, self.sent = 0, None, None, False

    def holds(self, size: int, packed: bytes) -> bool:
        if size != self.size:
            return False
        if packed == self.packed:
            return True
        unpack = zstandard.ZstdDecompressor()
        return unpack.decompress(packed, max_output_size=size + 1) == unpack.decompress(self.packed, max_output_size=size + 1)

    def add(self, ids: bytes, points: bytes) -> None:
        new = [(-p, False, i) if p >= 0 else (1 + p, True, 0) for i, p in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(points, "<i4").tolist(), strict=True)]
        self.count += len(new)
        self.best = min(new) if self.best is None else min(self.best, min(new))
        self.members += new


def _id(member: tuple[int, bool, int]) -> int | None:
    return None if member[1] else member[2]


def _own(batches):
    key, origin, chains = None, None, []
    rows: list[tuple] = []

    def close(chain: _Chain) -> None:
        keep = _id(chain.best)
        if chain.sent:
            flush(chain)
            rows.append((None, keep, chain.count, True, chain.sha, key, chain.number, "class", -chain.best[0]))
            return
        stays = False
        for m in chain.members:
            kept = not stays and m == chain.best
            stays |= kept
            rows.append((_id(m), keep, chain.count, kept, chain.sha, key, chain.number, "row", -m[0]))

    def flush(chain: _Chain) -> None:
        """Members whose class is still open; of equal candidates only the first of this task may stay."""
        for m in chain.members:
            may = m == chain.best != chain.claimed
            if may:
                chain.claimed = chain.best
            rows.append((_id(m), None, None, may, chain.sha, key, chain.number, "member", -m[0]))
        chain.members, chain.sent = [], True

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for new, task, seq, size, packed, sha, ids, points in zip(*(part.column(i).to_pylist() for i in range(1, 9)), strict=True):
                if new != key:
                    for chain in chains:
                        close(chain)
                    key, chains, origin = new, [], None
                if packed is not None:
                    chain = next((c for c in chains if c.holds(size, packed)), None)
                    if chain is None:
                        chain = _Chain(len(chains), size, packed, sha)
                        chains.append(chain)
                    origin, current = (task, seq), chain
                elif (task, seq) != origin:
                    raise AssertionError("an entry came before its text")
                current.add(ids, points)
                if current.count > RESOLVE_AT and len(current.members) > RESOLVE_AT // 4:
                    flush(current)
                if len(rows) >= _ROWS:
                    yield _batch(rows, _INDEX_KINDS, _INDEX)
                    rows.clear()
    for chain in chains:
        close(chain)
    yield _batch(rows, _INDEX_KINDS, _INDEX)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = base.select("text").mapInArrow(_histogram, "prefix int, size long").groupBy("prefix").agg(F.sum("size").alias("size")).toArrow()
    sizes = np.zeros(1 << BITS, np.int64)
    sizes[counted.column("prefix").to_numpy()] = counted.column("size").to_numpy()
    # owner tasks by bytes; small inputs split further, so that every core owns a few buckets
    parts = max(spark.sparkContext.defaultParallelism, int(sizes.sum()) // OWNER_BYTES + 1)
    directory = build_directory(sizes, min(bucket_bytes, max(16 << 10, int(sizes.sum()) // (4 * parts))))
    shared = spark.sparkContext.broadcast(directory)  # 4 bytes for each of 2**BITS prefixes
    entries = base.mapInArrow(lambda batches: _entries(shared.value)(batches), _ENTRY)
    dealt = entries.repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "task", "seq", F.col("packed").isNull())
    index = saved(dealt.mapInArrow(_own, _INDEX), "exact-index")
    done = index.where(F.col("kind") == "row").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    classes = index.where(F.col("kind") == "class").select("key", "chain", "keep_id", "group_size", F.col("points").alias("most"))
    members = index.where(F.col("kind") == "member").select("doc_id", "points", F.col("kept").alias("may"), "text_sha256", "key", "chain")
    # `may` marks one row of each (points, id) that led its class for a time; the last leader stays.
    stays = F.col("may") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
    late = members.join(classes, ["key", "chain"]).select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")
    return done.unionByName(late)


def text_sha256(text_col: str = "text") -> Column:
    """The digest that exact_dedup gives a text."""
    return F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE.decode(), ""), 256)


def pack_sha(text: str | None) -> str:
    """The digest of one text, for tests."""
    return hashlib.sha256(normalised(text)).hexdigest()
