"""Source divergence audit: how far the words of each source of a language are from those of its other sources and of the language.

1. Counts. Words are runs of ASCII letters and of all characters beyond ASCII, A to Z lower-cased. Each task counts them by (language, source,
   word), with the documents that hold them, about CHUNK bytes of text at a time; one shuffle by (language, word) sums the counts and
   keeps the words in at least `min_docs` documents of the language. A word has one row for each chunk and source at most before that shuffle.
2. Blocks. A language's kept words are dealt to blocks of about BLOCK words by their hash, and its sources to blocks of GROUPS, so a task holds
   a pair of source blocks in a block of words: int64 tiles of a row a source and a column a word, of bounded size however many
   sources or words there are. With them travel the totals of the sources, so that sources without any kept word are rows too.
3. Tiles. p = 1 + floor(10^9 (count + 1) / (total + words)), by long division where a count times 10^9 would not fit. For each source of a tile
   floor((p - q)^2 / q) against all rows at once by broadcasting, summed over the block: a partial matrix of pairs. Those are added by pair.
   Against the whole language's q, each source keeps the `top` words of the block with the highest values: a heap a block, merged by a rank
   that Spark cuts before its shuffle too.

All of this is in integers. Sums over words fit in 64 bits as a source's p add up to about 10^9 plus the number of its language's kept words.

Defined cases: null text, language and source are '' (with '' a language and a source like others); a source without kept words has
p = 1 + floor(10^9 / words) everywhere, and all its values are 0 where its language has no kept word; a language with a single source has no pairs;
repeated rows count again; an empty table gives no rows; texts are counted whole, and one text must fit in a worker; columns with
clashing names are left out, as only three are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, saved
from .numeric import byte_words

MIN_DOCS, TOP = 3, 200
#: Words of a block and sources of a block: a tile has at most 2 * GROUPS * BLOCK cells or so.
BLOCK, GROUPS = 4096, 128
#: Bytes of text that a task counts before it gives out what it has.
CHUNK = 8 << 20
SCALE = 1_000_000_000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(texts: list[pa.Array], langs: list[pa.Array], sources: list[pa.Array]) -> pa.RecordBatch:
    """Words of some texts by language and source: occurrences, and texts that hold them."""
    lang, source = (pa.concat_arrays(x).dictionary_encode() for x in (langs, sources))
    pair = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    pairs, group = np.unique(pair, return_inverse=True)
    letters, lengths, row = byte_words(pa.concat_arrays(texts), _LETTERS)
    ends = np.cumsum(lengths).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.r_[np.int32(0), ends].tobytes()), pa.py_buffer(letters.tobytes())])
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    held, n = np.unique(code * len(group) + row, return_counts=True)  # a row a word and text
    code, row = held // max(1, len(group)), held % max(1, len(group))
    key, inverse = np.unique(code * len(pairs) + group[row], return_inverse=True)
    docs = np.bincount(inverse, minlength=len(key)).astype(np.int64)
    total = np.bincount(inverse, n, len(key)).astype(np.int64)
    code, of = key // max(1, len(pairs)), pairs[key % max(1, len(pairs))]
    width = max(1, len(source.dictionary))
    columns = [lang.dictionary.take(pa.array(of // width)), source.dictionary.take(pa.array(of % width)), coded.dictionary.take(pa.array(code)), pa.array(total), pa.array(docs)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _count(batches):
    parts: list[tuple[pa.Array, ...]] = []
    size = 0
    for batch in batches:
        parts.append(tuple(batch.columns))
        size += batch.column(0).nbytes
        if size >= CHUNK:
            yield _counted(*map(list, zip(*parts, strict=True)))
            parts, size = [], 0
    if parts:
        yield _counted(*map(list, zip(*parts, strict=True)))


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, and lang_n of the whole language, for the words kept."""
    bounded_batches(docs.sparkSession)
    read = docs.select(*(F.coalesce(quoted(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counts = read.select("text", "lang", "source").mapInArrow(_count, _COUNTS)
    dealt = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    return dealt.withColumns({"lang_n": F.sum("n").over(of), "_docs": F.sum("docs").over(of)}).where(F.col("_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n")


def group_totals(docs: DataFrame, counts: DataFrame, *, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each language and source: its place g among the language's sources, the sources, the total of its kept words,
    the kept words of the language and their total."""
    groups = docs.select(*(F.coalesce(quoted(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    words = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    joined = groups.join(sums, ["lang", "source"], "left").join(words, "lang", "left")
    return joined.select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("groups"),
        *(F.coalesce(c, zero).alias(c) for c in ("total", "words", "lang_total")),
    )


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), exactly for counts and wholes below 9 * 10^15."""
    part = count + 1
    if int(part.max(initial=0)) < 9_000_000_000:
        return 1 + SCALE * part // whole
    out = part // whole
    for _ in range(3):
        part = part % whole * 1000
        out = out * 1000 + part // whole
    return 1 + out


def _tiles(top: int):
    """Of the rows of a tile: partial sums of pairs of sources, and the highest words of each source where both source blocks are one."""

    def run(key, rows):
        lang, a, b = (key[i].as_py() for i in range(3))
        term = rows.column("term")
        column = lambda c, t: t.column(c).to_numpy()
        heads, cells = rows.filter(term.is_null()), rows.filter(term.is_valid())
        order = np.argsort(column("g", heads))
        places, totals = column("g", heads)[order], column("total", heads)[order]
        words, lang_total = (int(column(c, heads)[0]) for c in ("words", "lang_total"))
        coded = cells.column("term").combine_chunks().dictionary_encode() if cells.num_rows else pa.array([], pa.string()).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code, row = coded.indices.to_numpy(), np.searchsorted(places, column("g", cells))
        count = np.zeros((len(places), len(coded.dictionary)), np.int64)
        count[row, code] = column("n", cells)
        p = shares(count, (totals + words)[:, None]) if words else count
        left = [], [], [], [], []
        first = np.flatnonzero(places // GROUPS == a)
        second = np.flatnonzero(places // GROUPS == b)
        for mine, others in ((first, second), *([(second, first)] if a != b else [])):
            for i in mine.tolist():
                gap = p[i] - p[others]
                value = (gap * gap // p[others]).sum(1) if p.shape[1] else np.zeros(len(others), np.int64)
                left[0].append(np.full(len(others), places[i]))
                left[1].append(places[others])
                left[3].append(value)
        pairs = [np.concatenate(left[k]) if left[k] else np.zeros(0, np.int64) for k in (0, 1, 3)]
        apart = pairs[0] != pairs[1]
        parts = [(pairs[0][apart], pairs[1][apart], None, pairs[2][apart])]
        if a == b and p.shape[1]:
            lang_n = np.zeros(p.shape[1], np.int64)
            lang_n[code] = column("lang_n", cells)
            q = shares(lang_n, np.int64(lang_total + words))
            names = np.array([t.encode() for t in coded.dictionary.to_pylist()], object)
            by_name = np.empty(len(names), np.int64)
            by_name[np.argsort(names, kind="stable")] = np.arange(len(names))
            for i in range(len(places)):
                over = np.flatnonzero((count[i] > 0) & (p[i] > q))
                gap = p[i][over] - q[over]
                value = gap * gap // q[over]
                best = np.lexsort((by_name[over], -value))[:top]
                parts.append((np.full(len(best), places[i]), np.full(len(best), -1), coded.dictionary.take(pa.array(over[best])), value[best]))
        made = [pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(g, pa.int32()), "other": pa.array(o, pa.int32()), "term": pa.nulls(len(g), pa.string()) if t is None else t, "value": pa.array(v, pa.int64())}) for g, o, t, v in parts]
        return pa.concat_tables(made)

    return run


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: `pair` against each other source of the language, `term` for the words that a source
    has more of than its language, the `top` ones."""
    counts = saved(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, min_docs=min_docs), "divergence-counts")
    groups = saved(group_totals(docs, counts, lang_col=lang_col, source_col=source_col), "divergence-groups")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(BLOCK)))
    source_blocks = F.ceil(F.col("groups") / F.lit(GROUPS)).cast("int")
    known = counts.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    columns = ["lang", "g", "groups", "term", "n", "lang_n", "total", "words", "lang_total"]
    none = F.lit(None).cast("long")
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumns({"term": F.lit(None).cast("string"), "n": none, "lang_n": none})
    rows = known.select(*columns, "block").unionByName(heads.select(*columns, "block"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), source_blocks - 1))).withColumn("_own", F.floor(F.col("g") / GROUPS).cast("int"))
    rows = rows.withColumns({"a": F.least("_own", "_other"), "b": F.greatest("_own", "_other")})
    tiles = rows.select("lang", "a", "b", "block", *columns[1:]).groupBy("lang", "a", "b", "block").applyInArrow(_tiles(top), "lang string, g int, other int, term string, value long")
    tiles = saved(tiles, "divergence-tiles")
    summed = tiles.where("other >= 0").groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    names, others = groups.select("lang", "g", "source"), groups.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))
    order = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    pairs = summed.join(names, ["lang", "g"]).join(others, ["lang", "other"]).withColumn("rank", F.row_number().over(order()))
    heap = tiles.where("other < 0").select("lang", "g", F.col("term").alias("item"), "value")
    best = heap.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top).join(names, ["lang", "g"])
    return shape(pairs, "pair").unionByName(shape(best, "term"))
