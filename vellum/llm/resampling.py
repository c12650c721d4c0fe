"""Target-distribution importance resampling: documents drawn by how much likelier their words are in a target than in the corpus.

1. Counts. Words are lower-cased runs of ASCII letters and digits and of all characters beyond ASCII; features are all runs of up to
   `max_words` of them, joined by a space; a feature's bucket is the CRC-32 of its bytes modulo `buckets`. Each task sums its texts
   into one array of counts, and the arrays are summed by bucket: `buckets` sums (a parameter) come to the driver.
2. Weights. A bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))); a document's weight is the sum over its features, gathered from the
   array of gains for a batch at a time.
3. Scores. weight + floor(-1000 ln(-ln((h+0.5)/2^32))), Gumbel noise from h, the first 32 bits of SHA-256 of "seed:id": the
   highest scores are a draw without replacement in proportion to exp(weight / 1000).
4. Draw. The k-th key of (score descending, id) is found by radix selection: each pass counts the 16-bit digits of the rows that agree with
   the digits found so far (65,536 counts at most come to the driver), so no row is sorted to find it. Only the rows up to that key are then
   dealt by ranges and sorted, and ranked from their place and the sizes of the ranges before.

Defined cases: a null or wordless text has no feature and weight 0, and is not drawn if `min_words` is over 0; a null id counts as the
empty text in the noise and comes after all ids; repeated rows are rows of their own, and of those that tie in score and id the one with fewer
features is drawn first, then in the order of the table's files; an empty table gives no rows and an empty target counts
nothing; texts are counted whole, and one text must fit in a worker; other columns pass through if they are carried, but for those that have
the name of a new one, in whatever case, which give way.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, quoted, saved
from .numeric import byte_words

BUCKETS, MAX_WORDS, MIN_WORDS, SEED = 10_000, 1, 20, 2024
#: Documents drawn, in hundredths of those with enough words.
PERCENT = 10
NEW = ("n_features", "weight", "score", "rank")
DIGIT = 16
#: Features of up to so many bytes take a step a byte for all at once; longer ones go one by one.
STEPS = 64

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of data."""
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero(lengths <= STEPS)
    short = short[np.argsort(-lengths[short], kind="stable")]
    at, left = starts[short], np.sort(lengths[short])
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[-1]) if len(left) else 0):
        n = len(left) - int(np.searchsorted(left, k, "right"))  # those with a byte k come first
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out[short] = ~crc
    for i in np.flatnonzero(lengths > STEPS).tolist():
        out[i] = zlib.crc32(data[int(starts[i]) : int(starts[i] + lengths[i])])
    return out


def features_in(texts: pa.Array, buckets: int, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of each feature, and the words of each row."""
    letters, lengths, row = byte_words(texts, _LETTERS)
    sizes = np.bincount(row, minlength=len(texts)).astype(np.int64)
    if max_words > 1:  # with a space behind each word, a run is one span
        data = np.full(len(letters) + len(lengths), 0x20, np.uint8)
        data[np.arange(len(letters)) + np.repeat(np.arange(len(lengths)), lengths)] = letters
        gap = 1
    else:
        data, gap = letters, 0
    ends = np.cumsum(lengths + gap) - gap
    starts = ends - lengths
    found, rows = [], []
    for n in range(1, max_words + 1):
        first = np.arange(max(0, len(starts) - n + 1))
        first = first[row[first] == row[first + n - 1]]
        found.append((crc32s(data, starts[first], ends[first + n - 1] - starts[first]) % buckets).astype(np.int64))
        rows.append(row[first])
    return np.concatenate(found), np.concatenate(rows), sizes


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> np.ndarray:
    """Features of all texts by bucket."""
    bounded_batches(texts.sparkSession)

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(features_in(batch.column(0), buckets, max_words)[0], minlength=buckets)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(sums[full])], ["bucket", "n"])

    parts = texts.select(quoted(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, by bucket."""
    b = len(source)
    s_all, t_all = int(source.sum()) + b, int(target.sum()) + b
    return np.array([math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, *, text_col: str = "text", carry: list[str] | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """The carried columns (all if none are named) with n_features, n_words and weight, all long."""
    spark = docs.sparkSession
    bounded_batches(spark)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in (*NEW, "n_words")]
    rows = docs.select(quoted(text_col).cast("string").alias("_text"), F.struct(*map(quoted, carry)).alias("_row"))
    shared = spark.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def score(batches):
        table = shared.value
        for batch in batches:
            found, row, sizes = features_in(batch.column(0), len(table), max_words)
            weight = np.zeros(batch.num_rows, np.int64)
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if max_words == 1 and len(row) else None
            if heads is None:
                np.add.at(weight, row, table[found])
            else:  # rows are in order
                weight[row[heads]] = np.add.reduceat(table[found], heads)
            numbers = [np.bincount(row, minlength=batch.num_rows).astype(np.int64), sizes, weight]
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, numbers)], ["_row", "n_features", "n_words", "weight"])

    schema = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight"))])
    out = rows.mapInArrow(score, schema)
    return out.select([F.col("_row")[c].alias(c) for c in carry] + ["n_features", "n_words", "weight"])


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, keys: list[str], k: int) -> Column:
    """A predicate that holds for the k rows with the smallest keys (long columns, of which no two rows share all).

    One aggregation for the bounds, and one for each digit that is looked at.
    """
    bounds = rows.agg(*(f(c) for c in keys for f in (F.min, F.max))).first()
    parts: list[tuple[Column, int]] = []  # nonnegative columns and their bits, most significant first
    for i, c in enumerate(keys):
        low, high = bounds[2 * i], bounds[2 * i + 1]
        if low is None or low == high:
            continue
        if high - low < 1 << 62:
            parts.append((F.col(c) - F.lit(low), (high - low).bit_length()))
        else:
            parts += [(F.shiftright(c, 32) + F.lit(1 << 31), 32), (F.col(c).bitwiseAND(F.lit((1 << 32) - 1)), 32)]
    less, same, left = F.lit(False), F.lit(True), k
    for value, bits in parts:
        prefix, shift = 0, DIGIT * -(-bits // DIGIT)
        while shift:
            shift -= DIGIT
            digit = F.shiftright(value, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            alike = same & (F.shiftright(value, shift + DIGIT) == prefix) if shift + DIGIT < bits else same
            counts = sorted(tuple(r) for r in rows.where(alike).groupBy(digit.alias("digit")).agg(F.count(F.lit(1))).collect())
            for found, n in counts:
                if n >= left:
                    break
                left -= n
            prefix = (prefix << DIGIT) + found
            if n == left:  # all of them are taken
                return less | (same & (F.shiftright(value, shift) <= prefix))
        less, same = less | (same & (value < prefix)), same & (value == prefix)
    return less | same


def drawn(scored: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Rows of a saved table with `rank` 1 to k by the keys; the others have none. No two rows share all keys."""
    none = F.lit(None).cast("long").alias("rank")
    if k <= 0:
        return scored.select("*", none)
    taken = kth_key(scored, keys, k)
    ranges = scored.where(taken).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = saved(ranges.withColumn("_at", F.monotonically_increasing_id()), "drawn")  # the range, then the place in it
    of = F.shiftright("_at", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(of.alias("range")).agg(F.count(F.lit(1))).collect()}  # a row a range
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))]).tolist()
    offset = F.element_at(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), of.cast("int") + 1)
    ranked = placed.select(*map(quoted, scored.columns), (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))
    return scored.where(~taken).select("*", none).unionByName(ranked)


def resampled(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry: list[str] | None = None, buckets: int = BUCKETS,
    max_words: int = MAX_WORDS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """The carried columns of all documents (the id if none are named; ids are integers) with n_features, weight, score and rank.

    Of the N documents of at least min_words words, floor(percent N / 100) are drawn.
    """
    carry = list(dict.fromkeys([id_col, *(carry or [])]))
    gain = gains(bucket_counts(docs, text_col, buckets, max_words), bucket_counts(target, target_col, buckets, max_words))
    kept = [c for c in carry if c.lower() not in (*NEW, "n_words")]
    weighed = with_weights(docs.select(*map(quoted, dict.fromkeys([*kept, text_col]))), gain, text_col=text_col, carry=kept, max_words=max_words)
    keyed = weighed.withColumn("score", F.col("weight") + noise(id_col, seed)).select(
        F.struct(*map(quoted, kept)).alias("_row"), "n_features", "n_words", "weight", "score", (-F.col("score")).alias("_down"), quoted(id_col).isNull().cast("long").alias("_none"),
        F.coalesce(quoted(id_col).cast("long"), F.lit(0)).alias("_id"), F.monotonically_increasing_id().alias("_place"),
    )
    scored = saved(keyed, "resampling")
    enough = scored.where(F.col("n_words") >= min_words)
    k = percent * enough.count() // 100
    out = drawn(enough, k, ["_down", "_none", "_id", "n_features", "_place"]).unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select([F.col("_row")[c].alias(c) for c in kept] + list(NEW))
