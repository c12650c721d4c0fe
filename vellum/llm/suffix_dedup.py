"""Repeated-substring removal by a depth-limited radix sort of suffixes.

A suffix matters only through its first `depth` bytes: two suffixes equal that far are a repeated window.
The sort goes by most significant digit, and a suffix whose digit nobody shares leaves the sort.

* First digit: the suffix's minimizer, the smallest hash of the `gram`-byte strings inside its window, and
  where in the window it stands. Equal windows have equal minimizers at equal places, and neighbouring
  windows share theirs, so one row stands for a run of suffixes (about 1 row for 36 bytes). The rows
  travel as packed arrays. Minimizers that occur once end there.
* The surviving runs fetch the bytes their windows cover and are sorted by them, eight bytes a pass: all windows of a
  run that equals an earlier one repeat. What differs is sorted on window by window, to full depth.
* Groups equal at full depth are exactly the repeated windows; all but the earliest are removed.

A minimizer that very many documents share would fill its bucket, so those are counted first: in whole tasks where
they are frequent, by a sample of (minimizer, task) elsewhere. Their runs are cut into single windows that go by the hash of
their own bytes: the windows inside a common passage are equal and shrink to one for each batch, those at its edges differ and spread.

Documents that repeat an earlier one byte for byte are found by SHA-256 first and never enter the sort.

Defined cases: a null text is empty; a null id sorts last; rows that repeat id and text are one document,
whose result each of them gets; of rows with one id and different texts the one with the smaller SHA-256
comes first; very long texts go whole, in steps of _STEP windows; an empty table gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, bounded_batches, saved, spans_to_index, spread_join, text_bytes
from .numeric import gram_hashes, mix, sliding_min, summed

DEPTH = 100
GRAM = 32
#: Text bytes whose runs one bucket sorts; a bucket's arrays take about half of that.
BUCKET_BYTES = 24 << 20
#: A minimizer counts as frequent from so many occurrences on. A task reports those it has so often, and one of SAMPLED of
#: the others with that weight, and sums up to SUMMED of them at a time.
FREQUENT, IN_A_TASK, SAMPLED, SUMMED = 10_000, 8, 256, 1 << 21
#: The frequent ones are broadcast; of more than this many, only the most frequent count.
FREQUENT_AT_MOST = 200_000
_POSITION = np.uint64((1 << 31) - 1)
#: Windows looked at in one step.
_STEP = 1 << 22

#: Kinds of the packed columns. A bucket holds few enough minimizers for 32 bits of their hashes: two that agree
#: by chance only send two runs on whose bytes then differ.
_KINDS = {"pos": "<i8", "tag": "<i8", "off": "<i4", "start": "<i4", "low": "<i2", "high": "<i2", "size": "<i2", "h": "<u4"}
_RISING = ("pos", "off", "start")
_RUNS = "bucket int, n int, pos binary, tag binary, off binary, low binary, high binary, h binary"
_LIVE = "pos long, tag long, off int, low short, high short, h long"  # h: bucket and 32 bits, or -1 for frequent ones
_WINDOWS = "bucket int, n int, pos binary, tag binary, start binary, low binary, high binary, h binary, size binary, bytes binary"
_COVER = "pos long, tag long, covers binary"


def runs_of(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Minimizer runs: row, minimizer's place in its text, first and last window start before it, gram hash."""
    out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
    for begin in range(0, len(data) - depth + 1, _STEP):  # in steps, however long a text is
        end = min(begin + _STEP, len(data) - depth + 1)
        grams = gram_hashes(data[begin : end + depth - 1], gram)
        packed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        least = (sliding_min(packed, depth - gram + 1) & _POSITION).astype(np.int64)
        lo, hi = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left")
        first, last = np.maximum(offsets[lo:hi], begin) - begin, np.minimum(offsets[lo + 1 : hi + 1] - depth + 1, end) - begin
        mark = np.zeros(end - begin + 1, np.int8)
        np.add.at(mark, first[last > first], 1)
        np.subtract.at(mark, last[last > first], 1)
        windows = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
        if not len(windows):
            continue
        least = least[windows]
        # a run ends where the minimizer or the document changes; a minimizer lies in one document
        heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        tails = np.concatenate([heads[1:], [len(least)]]) - 1
        at = least[heads]
        row = np.searchsorted(offsets, at + begin, "right") - 1
        out.append((row, at + begin - offsets[row], at - windows[heads], at - windows[tails], grams[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _squeeze(values: np.ndarray, rising: bool) -> bytes:
    """Array as compressed bytes; rising ones as differences."""
    if rising:
        values = np.diff(values, prepend=values[:1] * 0)
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a bucket with packed arrays."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.concatenate([heads[1:], [len(bucket)]]) if len(heads) else heads
    out = {"bucket": pa.array(bucket[heads].astype(np.int32)), "n": pa.array((ends - heads).astype(np.int32))}
    for name, values in columns.items():
        values = values[order]
        out[name] = pa.array([_squeeze(values[a:b], name in _RISING) for a, b in zip(heads, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _count_in_tasks(depth: int, gram: int, least: int, sampled: int):
    """(h, n) of frequent minimizers. What a task has seldom is sampled by a hash of minimizer and task, so that one that
    many tasks have seldom is found too: the sums are its expected count."""

    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        salt = np.uint64(task * 0x9E3779B97F4A7C15 % 2**64)
        held, size = [], 0

        def out():
            h, n = summed(held)
            seldom = n < least
            lucky = mix(h ^ salt) % np.uint64(sampled) == 0
            keep = ~seldom | lucky
            n = np.where(seldom, n * sampled, n)[keep]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n)], ["h", "n"])

        for batch in batches:
            held.append(np.unique(runs_of(*text_bytes(batch.column(2)), depth, gram)[4], return_counts=True))
            size += len(held[-1][0])
            if size > SUMMED:
                held[:] = [summed(held)]
                size = len(held[0][0])
                if size > SUMMED // 2:
                    yield out()
                    size = 0
        yield out()

    return run


def _emit_runs(depth: int, gram: int, buckets: int, frequent: np.ndarray):
    """Runs packed by bucket. Those of frequent minimizers are known to be shared; they go to the bucket of their document."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            row, off, high, low, h = runs_of(data, offsets, depth, gram)
            if len(row):
                pos, tag = (batch.column(i).to_numpy()[row] for i in (0, 1))
                where = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                if len(frequent):
                    often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
                    where = np.where(often, -1 - pos % buckets, where)
                yield _pack(where, {"pos": pos, "tag": tag, "off": off.astype(np.int32), "low": low.astype(np.int16), "high": high.astype(np.int16), "h": h.astype(np.uint32)})

    return run


def _by_bucket(batches):
    """All rows of a bucket at a time, from batches in bucket order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[-1].column(0)[0].as_py() != bucket[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _unpack(rows: pa.Table, name: str) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(expand.decompress(x), _KINDS[name]) for x in rows.column(name).to_pylist()]
    return np.concatenate([np.cumsum(x, dtype=x.dtype) if name in _RISING else x for x in parts])


def _shared_minimizers(batches):
    names = ["pos", "tag", "off", "low", "high", "h"]
    for rows in _by_bucket(batches):
        columns = {name: _unpack(rows, name) for name in names}
        bucket = rows.column("bucket")[0].as_py()
        if bucket < 0:
            order, columns["h"] = np.arange(len(columns["h"])), np.full(len(columns["h"]), -1)
        else:
            order = np.argsort(columns["h"], kind="stable")
            s = columns["h"][order]
            same = np.concatenate([[False], s[1:] == s[:-1], [False]])
            order = np.sort(order[same[1:] | same[:-1]])
            columns["h"] = columns["h"].astype(np.int64) | (bucket << 32)
        for at in range(0, len(order), 50_000):
            yield pa.RecordBatch.from_pydict({name: pa.array(columns[name][order[at : at + 50_000]]) for name in names})


def _emit_windows(depth: int, buckets: int):
    """Bytes under the windows of each surviving run. Of runs that are equal within the batch only the first goes on;
    the others are covered by it, which is known here. Runs of frequent minimizers are cut into single windows."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("runs")
            n = np.diff(lists.offsets.to_numpy())
            if not n.sum():
                continue
            flat = lists.flatten()
            off, low, high, h = (flat.field(name).to_numpy().astype(np.int64) for name in ("off", "low", "high", "h"))
            row = np.repeat(np.arange(len(n)), n)
            start = off - high
            often = np.flatnonzero(h < 0)
            if len(often):
                count = (high - low + 1)[often]
                at = np.repeat(start[often], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                rest, who = np.flatnonzero(h >= 0), np.repeat(row[often], count)
                own = mix(gram_hashes(data, depth)[offsets[who] + at]) if len(at) else np.zeros(0, np.uint64)
                where = ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                row, start = np.concatenate([row[rest], who]), np.concatenate([start[rest], at])
                # a place of its own, beyond any real one, keeps single windows from meeting runs
                low, high = (np.concatenate([x[rest], np.full(len(at), depth, np.int64)]) for x in (low, high))
                h = np.concatenate([h[rest], (where << 32) | (own & np.uint64(0xFFFFFFFF)).astype(np.int64)])
            size = high - low + depth
            pos, tag = (batch.column(c).to_numpy()[row] for c in ("pos", "tag"))
            order = np.lexsort((start, tag, pos))  # earliest first
            begin = offsets[row] + start
            same = equal_runs(data, begin[order], size[order], grouped(h[order], low[order], high[order]))
            lead = first_of(same)
            kept, gone = order[lead], order[~lead]
            where = h[kept] >> 32
            rank = np.argsort(where, kind="stable")
            out = _pack(where, {"pos": pos[kept], "tag": tag[kept], "start": start[kept].astype(np.int32), "low": low[kept].astype(np.int16), "high": high[kept].astype(np.int16), "h": (h[kept] & 0xFFFFFFFF).astype(np.uint32), "size": size[kept].astype(np.int16)})
            cuts = np.concatenate([[0], np.cumsum(out.column("n").to_numpy())]).tolist()
            squeeze = zstandard.ZstdCompressor(level=3)
            joined = [squeeze.compress(data[spans_to_index(begin[kept[rank[a:b]]], size[kept[rank[a:b]]])].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            names = [x.split()[0] for x in _WINDOWS.split(", ")]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(joined, pa.binary())], names)
            if len(gone):
                spans = {"pos": pos[gone], "tag": tag[gone], "start": start[gone].astype(np.int32), "size": size[gone].astype(np.int16)}
                extra = _pack(-1 - pos[gone] % buckets, spans)
                blank = pa.nulls(extra.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([extra.column(c) if c in extra.schema.names else blank for c in names], names)

    return run


def _ranks(group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, digit) and, in that order, new group numbers."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    return order, np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]))


def _digits(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a digit."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data.tobytes(), strides=(1,)) if len(data) >= 8 else np.zeros(0, ">u8")


def grouped(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row of the columns."""
    order = np.lexsort(columns)
    new = np.concatenate([[False], np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])]) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def first_of(number: np.ndarray) -> np.ndarray:
    """Whether each row is the first with its number."""
    out = np.zeros(len(number), bool)
    out[np.unique(number, return_index=True)[1]] = True
    return out


def equal_runs(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each run (start, size; sizes are alike within a group): equal for runs of one group that are equal byte
    for byte. Most significant digit first; a run whose digits nobody shares leaves."""
    out = np.arange(len(at))
    alive, wide = np.arange(len(at)), _digits(data)
    digit = 0
    while len(alive):
        ends = digit + 8 >= size[alive]  # the last digit of these
        order, number = _ranks(group, wide[at[alive] + np.minimum(digit, size[alive] - 8)].astype(np.uint64))
        many = np.bincount(number)[number] > 1
        alive, number, ends = alive[order], number, ends[order]
        done = many & ends
        if done.any():
            who, label = alive[done], number[done]
            heads = np.concatenate([[True], label[1:] != label[:-1]])
            least = np.minimum.reduceat(who, np.flatnonzero(heads))
            out[who] = least[np.cumsum(heads) - 1]
        on = many & ~ends
        alive, group = alive[on], number[on]
        digit += 8
    return out


def repeated_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of windows (starts `at` in data) that equal another of their group through depth, and group numbers."""
    alive, wide = np.arange(len(at)), _digits(data)
    for digit in [*range(0, depth - 7, 8), depth - 8]:
        if not len(alive):
            break
        order, number = _ranks(group, wide[at[alive] + digit].astype(np.uint64))
        many = np.bincount(number)[number] > 1
        alive, group = alive[order[many]], number[many]
    return alive, group


def _refine(depth: int):
    def run(batches):
        for rows in _by_bucket(batches):
            pos, tag = (_unpack(rows, c) for c in ("pos", "tag"))
            if rows.column("bucket")[0].as_py() < 0:  # covered in their batch
                start, size = (_unpack(rows, c).astype(np.int64) for c in ("start", "size"))
                yield from _cover_rows(pos, tag, start, start + size)
                continue
            start, h, low, high, size = (_unpack(rows, c).astype(np.int64) for c in ("start", "h", "low", "high", "size"))
            expand = zstandard.ZstdDecompressor()
            joined = np.frombuffer(b"".join(expand.decompress(x) for x in rows.column("bytes").to_pylist()), np.uint8)
            begin = np.cumsum(size) - size
            order = np.lexsort((start, tag, pos))  # earliest first
            # runs equal to an earlier one: every window of theirs is a repeat
            same = equal_runs(joined, begin[order], size[order], grouped(h[order], low[order], high[order]))
            follow, lead = order[~first_of(same)], order[first_of(same)]
            _, number, many = np.unique(h[lead], return_inverse=True, return_counts=True)
            lead, number = lead[many[number] > 1], number[many[number] > 1]
            # lead is in order of position, so a window's index in it is its rank
            count = (high - low + 1)[lead]
            owner = np.repeat(np.arange(len(lead)), count)
            shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = high[lead][owner] - shift  # bytes before the minimizer
            alive, group = repeated_windows(joined, begin[lead][owner] + shift, number[owner] * (depth + 1) + place, depth)
            rank = np.lexsort((shift[alive] + start[lead][owner[alive]], tag[lead][owner[alive]], pos[lead][owner[alive]], group))
            alive, group = alive[rank], group[rank]
            again = alive[np.concatenate([[False], group[1:] == group[:-1]])] if len(alive) else alive
            w_lead, w_start = lead[owner[again]], start[lead][owner[again]] + shift[again]
            a = np.concatenate([start[follow], w_start]).astype(np.int64)
            b = np.concatenate([start[follow] + size[follow], w_start + depth]).astype(np.int64)
            p, t = np.concatenate([pos[follow], pos[w_lead]]), np.concatenate([tag[follow], tag[w_lead]])
            yield from _cover_rows(p, t, a, b)

    return run


def merged(a: np.ndarray, b: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans a..b of each document; touching spans merge. Sorted by document, then start."""
    order = np.lexsort((a, document))
    a, b, document = a[order], b[order], document[order]
    if not len(a):
        return a, b, document
    # spans of later documents lie beyond all spans of earlier ones on a common axis
    room = int(b.max()) + 2
    _, dense = np.unique(document, return_inverse=True)
    reach = np.maximum.accumulate(b + dense * room)
    heads = np.concatenate([[True], (a + dense * room)[1:] > reach[:-1]])
    ends = np.flatnonzero(np.concatenate([heads[1:], [True]]))
    return a[heads], reach[ends] - dense[ends] * room, document[heads]


def _cover_rows(pos, tag, a, b):
    if not len(pos):
        return
    keys, document = np.unique(np.stack([pos, tag], 1), axis=0, return_inverse=True)
    a, b, document = merged(a, b, document.ravel())
    heads = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
    cuts = np.concatenate([heads, [len(a)]])
    spans = np.stack([a, b], 1).astype("<i4")
    who = keys[document[heads]]
    yield pa.RecordBatch.from_pydict({"pos": pa.array(who[:, 0]), "tag": pa.array(who[:, 1]), "covers": pa.array([spans[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _results(depth: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, covers, later in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "covers", "later")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if later and len(data) >= depth:
                    a, b = np.array([0]), np.array([len(data)])
                else:
                    spans = np.frombuffer(b"".join(covers or ()), "<i4").astype(np.int64).reshape(-1, 2)
                    a, b, _ = merged(spans[:, 0], spans[:, 1], np.zeros(len(spans), np.int64))
                kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
                rows.append((doc_id, len(data), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of every row."""
    if not 8 <= gram <= depth:
        raise ValueError("gram must lie between 8 and depth")
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pos = F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID))
    # no column may be null: a plan that filters nulls would not share the exchange of texts below
    none = F.col(id_col).isNull()
    base = docs.select(pos.alias("pos"), none.alias("none"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    meta = saved(base.select("pos", "none", "sha", F.octet_length("text").alias("size")), "repeat-meta")
    total = meta.agg(F.sum("size")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, 16, int(np.ceil(total / BUCKET_BYTES)))

    # a tag tells texts of one place apart, if any has several; rows without an id come last
    several = meta.groupBy("pos").agg(F.count_distinct("none", "sha").alias("n")).where("n > 1").limit(1).count()
    keys = ["pos", "tag"] if several else ["pos"]
    told = [(F.conv(F.substring("sha", 1, 14), 16, 10).cast("long") + F.when(F.col("none"), 1 << 60).otherwise(0)).alias("tag")] if several else []
    told = [F.coalesce(t, F.lit(0)).alias("tag") for t in told]
    tag = F.col("tag") if several else F.lit(0).cast("long").alias("tag")
    firsts = meta.groupBy("sha").agg(F.min(F.struct("pos", "none")).alias("first"), F.max(F.struct("pos", "none")).alias("last")).where("first < last").select("sha", "first")
    later = saved(spread_join(meta, firsts, "sha").where(F.struct("pos", "none") > F.col("first")).select("pos", *told).distinct().withColumn("later", F.lit(True)), "repeat-later")
    # the one exchange of texts: each later use of `dealt` reuses it
    dealt = base.select("pos", "none", *told, "text").repartition(parts, *keys).join(later, keys, "left")
    fresh = dealt.where("later is null").select("pos", tag, "text", "none")  # every use of the exchange has all its columns
    scanned = base.select("pos", "sha", "text")  # counted where the texts are read, before their exchange
    often = scanned.mapInArrow(_count_in_tasks(depth, gram, IN_A_TASK, SAMPLED), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = np.sort(np.array([r[0] for r in often.orderBy(F.desc("n"), "h").limit(FREQUENT_AT_MOST).select("h").collect()], np.int64).view(np.uint64))
    runs = fresh.mapInArrow(_emit_runs(depth, gram, buckets, frequent), _RUNS)
    live = runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_minimizers, _LIVE)
    lists = live.groupBy(*keys).agg(F.collect_list(F.struct("off", "low", "high", "h")).alias("runs"))
    windows = fresh.join(lists, keys).select("pos", "tag", "text", "runs", "none").mapInArrow(_emit_windows(depth, buckets), _WINDOWS)
    covers = windows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_refine(depth), _COVER)
    covers = covers.groupBy(*keys).agg(F.collect_list("covers").alias("covers"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text
    doc_id = F.when(~F.col("none"), F.col("pos")).alias("doc_id")
    return dealt.join(covers, keys, "left").select(doc_id, "text", "covers", "later").mapInArrow(_results(depth, with_text), schema)
