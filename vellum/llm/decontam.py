"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

The index holds the benchmark only, as normalised impacts: a term's BM25 weight in an item divided by the score of the
item's own text, so a passage with the whole item scores 1. Items are indexed by classes of length; for each class
every document is cut into overlapping passages such that any item of the class lies inside one, and every passage is
a query. All items at or above `threshold` are retrieved.

* Bounds over all passages of a batch at once drop those that no pivot can come of. Each item's commonest terms, short
  of the threshold together, are set aside: what they may add is known. Over the other terms come the passage's sum of
  term maxima, then its sum of block maxima for each block of items, and that again over all terms.
* The passages left are walked by block-max WAND, item at a time: cursors in item order, the pivot where term maxima
  reach the threshold, the block maxima at the pivot, then a score of the item or a skip past the block.

A retrieved pair is a leak if the passage has at least `overlap` of the item's 5-word shingles (an item of
fewer words: the whole sequence) and of the distinct words of its question and of its answer. The answer
is the item's last sentence; if there is only one, the last quarter of its words.

A benchmark of over `block_items` items is indexed in blocks, each built, broadcast and dropped for a pass of its own; BM25 statistics are
those of all items, so the blocks change neither leaks nor scores. Defined cases: null and empty texts and items have no words and
match nothing; items without an id are items like others, reported with a null id, after the others; repeated items are reported each; ties
are all reported; documents without an id and repeated rows are searched like others; an empty benchmark finds nothing, and an empty
table has no rows; texts and items of any length go whole; other columns pass through, and one named as the output column, in whatever
case, gives way to it. One narrow pass a block, no shuffle of documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, quoted, saved, spans_to_index, text_bytes

K1, B = 1.2, 0.75
SHINGLE = 5
OVERLAP = 0.8
THRESHOLD = 0.5
BLOCK = 16
#: Share of the threshold that an item's commonest terms may make up without being looked up first.
COMMON = 0.7
#: Items that one index has at most, as it is broadcast, and passes that are piped one into the next.
BLOCK_ITEMS, PIPED = 50_000, 4
#: Most words of the items of the first class; each further class has twice as many.
SHORT = 32

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("overlap", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])

#: Bytes of ASCII letters and digits stay, as do those of other letters; the rest of ASCII separates words.
_SPLIT = np.arange(256, dtype=np.uint8)
_SPLIT[:128] = 0x20
_SPLIT[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B)]
#: Lead byte, second bytes and length of blocks of punctuation and symbols: U+0080-00BF, U+2000-2BFF, U+3000-303F.
_MARKS = ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0xAF, 3), (0xE3, 0x80, 0x80, 3))


def words_in(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts on end, and the number of words of each."""
    data, offsets = text_bytes(pc.utf8_lower(array))
    flat = _SPLIT[data]
    for lead, low, high, size in _MARKS:
        at = np.flatnonzero(data == lead)
        at = at[(data[at + 1] >= low) & (data[at + 1] <= high)] if len(at) else at
        for i in range(size if len(at) else 0):
            flat[at + i] = 0x20
    texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat))
    words = pc.ascii_split_whitespace(texts)
    kept = pc.not_equal(words.flatten(), "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(kept)])[words.offsets.to_numpy()]
    return words.flatten().filter(pa.array(kept)), np.diff(ends)


def words_of(text: str | None) -> list[str]:
    return words_in(pa.array([text or ""], pa.string()))[0].to_pylist()


@dataclass
class Item:
    """Words are numbers in the index's vocabulary."""

    item_id: int | None
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray


def parted(text: str) -> tuple[list[str], list[str], list[str]]:
    """Words of an item, of its question and of its answer."""
    words = words_of(text)
    sentences = [w for s in re.split(r"(?<=[.!?])\s+", text.strip()) if (w := words_of(s))]
    answer = sentences[-1] if len(sentences) > 1 else words[-max(1, len(words) // 4) :]
    return words, words[: len(words) - len(answer)] or answer, answer


def shingles_of(words: np.ndarray, size: int) -> set[tuple]:
    return set(zip(*(words[i : len(words) - size + i + 1].tolist() for i in range(size)), strict=True)) if size else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items that have words: how many, how long on average, and how many hold a word."""

    items: int
    mean: float
    df: dict[str, int]


def _by_id(item_id: int | None) -> tuple[bool, int]:
    return item_id is None, item_id or 0


class Index:
    """Items of a benchmark, or of a block of one, by classes of length over one vocabulary. Without statistics, those of the items count."""

    def __init__(self, items: list[tuple[int | None, str]], block: int = BLOCK, threshold: float = THRESHOLD, statistics: Statistics | None = None):
        texts = [(i, *parts) for i, t in sorted(items, key=lambda x: (_by_id(x[0]), x[1])) if (parts := parted(t))[0]]
        vocabulary = sorted({w for _, words, *_ in texts for w in words})
        self.vocabulary = pa.array(vocabulary, pa.string())
        number = {w: i for i, w in enumerate(vocabulary)}
        coded = lambda words: np.array([number[w] for w in words], np.int64)
        self.items = [Item(i, coded(w), np.unique(coded(q)), np.unique(coded(a))) for i, w, q, a in texts]
        if statistics is None:
            df = np.bincount(np.concatenate([np.unique(x.words) for x in self.items]), minlength=len(vocabulary)) if self.items else np.zeros(0)
            n, mean = len(self.items), sum(len(x.words) for x in self.items) / max(1, len(self.items))
        else:
            df = np.array([statistics.df[w] for w in vocabulary], np.int64)
            n, mean = statistics.items, statistics.mean
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        by_class: dict[int, list[Item]] = {}
        for x in self.items:
            by_class.setdefault(max(0, int(np.ceil(np.log2(len(x.words) / SHORT)))), []).append(x)
        self.classes = [Postings(by_class[c], SHORT << c, idf, mean, block, threshold) for c in sorted(by_class)]


class Postings:
    """Impact-ordered postings in compressed rows, by item and by block of items, of items of up to `longest` words."""

    def __init__(self, items: list[Item], longest: int, idf: np.ndarray, mean: float, block: int, threshold: float):
        self.items, self.threshold, self.block, self.stride = items, threshold, block, longest // 2
        n, lengths = len(items), np.array([len(x.words) for x in items], float)
        parts = [np.unique(x.words, return_counts=True) for x in items]
        term, tf = (np.concatenate(v) for v in zip(*parts, strict=True))
        item = np.repeat(np.arange(n), [len(t) for t, _ in parts])
        df = np.bincount(term, minlength=len(idf))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        weight /= np.maximum(np.bincount(item, weight, n)[item], 1e-12)
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])
        # each item's terms from the commonest on; those within the share are set aside
        by_item = np.lexsort((term, -df[term], item))
        running = np.cumsum(weight[by_item])
        start = np.concatenate([[0], np.flatnonzero(item[by_item][1:] != item[by_item][:-1]) + 1])
        running -= np.repeat((running - weight[by_item])[start], np.diff(np.concatenate([start, [len(item)]])))
        aside = np.zeros(len(item), bool)
        aside[by_item] = running <= COMMON * threshold
        blocks = n // block + 1
        rest = np.bincount(item[aside], weight[aside], n)
        self.rest = np.zeros(blocks)
        np.maximum.at(self.rest, np.arange(n) // block, rest)
        looked = order[~aside[order]]
        self.block_of, self.block_max, self.block_at, self.top = self._maxima(term[looked], item[looked] // block, weight[looked], blocks, len(idf))
        # the same over all terms, for the walk
        self.bound_of, self.bounds, self.bounds_at, self.tops = self._maxima(term[order], item[order] // block, weight[order], blocks, len(idf))
        self.cursors: dict[int, tuple[list[int], list[float], dict[int, float], float]] = {}

    @staticmethod
    def _maxima(term: np.ndarray, block: np.ndarray, weight: np.ndarray, blocks: int, terms: int) -> tuple[np.ndarray, ...]:
        """Blocks and maxima by term, where each term's begin, and term maxima; from postings by term and item."""
        key = term * blocks + block
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, heads) if len(key) else np.zeros(0)
        top = np.zeros(terms)
        np.maximum.at(top, term, weight)
        return block[heads], most, np.concatenate([[0], np.cumsum(np.bincount(term[heads], minlength=terms))]), top

    def cursor(self, term: int) -> tuple[list[int], list[float], dict[int, float], float]:
        """Items and weights of a term in item order, its block maxima and its maximum; kept for further passages."""
        if (known := self.cursors.get(term)) is None:
            lo, hi, b, e = self.at[term], self.at[term + 1], self.bounds_at[term], self.bounds_at[term + 1]
            known = self.cursors[term] = self.item[lo:hi].tolist(), self.weight[lo:hi].tolist(), dict(zip(self.bound_of[b:e].tolist(), self.bounds[b:e].tolist(), strict=True)), float(self.tops[term])
        return known

    def walk(self, terms: list[int], blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """(item, score) at or above the threshold of a passage with these distinct terms: block-max WAND. blocks: those,
        in order, that bounds have left; all of them if none are given."""
        least, found = self.threshold - 1e-9, []
        blocks = list(range(len(self.rest))) if blocks is None else blocks
        # current item, place in the list, and the list itself
        cursors = [[c[0][0], k, 0, c] for k, t in enumerate(terms) if (c := self.cursor(t))[0]]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3][3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            block, front = at // self.block, cursors[: pivot + 1]
            place = bisect_left(blocks, block)
            if place == len(blocks):
                break
            if blocks[place] > block:
                target = blocks[place] * self.block
            elif sum(c[3][2].get(block, 0.0) for c in front) < least:
                target = max(at + 1, min([(block + 1) * self.block, *(c[0] for c in cursors[pivot + 1 : pivot + 2])]))
            elif front[0][0] < at:
                target = at
            else:
                score = sum(c[3][1][c[2]] for c in front)
                if score >= least:
                    found.append((at, score))
                target = at + 1
            for c in cursors if blocks[place] > block else front:
                if c[0] < target:
                    items = c[3][0]
                    c[2] = bisect_left(items, target, c[2])
                    c[0] = items[c[2]] if c[2] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def retrieve(self, terms: np.ndarray, segment: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the threshold. terms and their segment; segments: number of those of each
        document. Passage s is segments s to s + 2 of one document."""
        threshold = self.threshold
        total, blocks, width = int(segments.sum()), len(self.rest), max(1, len(self.top))
        left = np.repeat(np.cumsum(segments), segments) - np.arange(total)  # segments to the document's end, this one included
        # a passage that runs on past the document's end is inside the one that starts before it
        whole = (left >= 3) | (np.repeat(np.cumsum(segments) - segments, segments) == np.arange(total))
        used = self.top[terms] > 0
        t, at = terms[used], segment[used]
        bound = np.bincount(at, self.top[t], total)
        reach = bound.copy()
        for ahead in (1, 2):
            reach[: total - ahead] += np.where(left[: total - ahead] > ahead, bound[ahead:], 0)
        may = whole & (reach + self.rest.max(initial=0) >= threshold - 1e-9)
        # distinct terms of each passage that may reach the threshold
        pairs = []
        for back in (0, 1, 2):
            p = at - back
            good = p >= 0
            good &= may[p] & (left[p] > back)
            pairs.append(p[good] * width + t[good])
        pair = np.unique(np.concatenate(pairs))
        owner, term = pair // width, pair % width
        # block maxima
        n = self.block_at[term + 1] - self.block_at[term]
        key, inverse = np.unique(np.repeat(owner, n) * blocks + self.block_of[spans_to_index(self.block_at[term], n)], return_inverse=True)
        upper = np.bincount(inverse, self.block_max[spans_to_index(self.block_at[term], n)], len(key)) + self.rest[key % blocks]
        key = key[upper >= threshold - 1e-9]
        # the same with all terms of the passages left, nothing set aside
        passage = np.unique(key // blocks)
        begin = np.searchsorted(segment, passage)
        size = np.searchsorted(segment, passage + np.minimum(3, left[passage])) - begin
        pair = np.unique(np.repeat(passage, size) * width + terms[spans_to_index(begin, size)])
        owner, term = pair // width, pair % width
        n = self.bounds_at[term + 1] - self.bounds_at[term]
        place, owners = spans_to_index(self.bounds_at[term], n), np.repeat(owner, n)
        inside = np.isin(owners * blocks + self.bound_of[place], key)
        pair, inverse = np.unique((owners * blocks + self.bound_of[place])[inside], return_inverse=True)
        pair = pair[np.bincount(inverse, self.bounds[place[inside]], len(pair)) >= threshold - 1e-9]
        passage, heads = np.unique(pair // blocks, return_index=True)
        left_blocks = np.split(pair % blocks, heads[1:])
        out: list[tuple[int, int, float]] = []
        for p, mine, a, b in zip(passage.tolist(), left_blocks, np.searchsorted(owner, passage).tolist(), np.searchsorted(owner, passage + 1).tolist(), strict=False):
            out += [(p, j, score) for j, score in self.walk(term[a:b].tolist(), mine.tolist())]
        passages, items, scores = zip(*out, strict=True) if out else ((), (), ())
        return np.array(passages, np.int64), np.array(items, np.int64), np.array(scores, float)


def find_leaks(index: Index, texts: pa.Array, overlap: float = OVERLAP) -> list[list[dict]]:
    """Leaks of each text, by item; of an item found in several passages the best one counts."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not index.items or not len(texts):
        return out
    words, sizes = words_in(texts)
    first = np.cumsum(sizes) - sizes
    coded = pc.fill_null(pc.index_in(words, value_set=index.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    place, known = np.arange(len(coded)) - np.repeat(first, sizes), coded >= 0
    best: dict[tuple[int, int, int], dict] = {}
    for c, postings in enumerate(index.classes):
        stride = postings.stride
        segments = -(-sizes // stride)
        base = np.cumsum(segments) - segments
        segment = np.repeat(base, sizes) + place // stride
        passages, items, scores = postings.retrieve(coded[known], segment[known], segments)
        documents = np.searchsorted(base + segments, passages, "right")
        for d, p, j, score in zip(documents.tolist(), passages.tolist(), items.tolist(), scores.tolist(), strict=True):
            item = postings.items[j]
            start = (p - int(base[d])) * stride
            passage = coded[int(first[d]) + start : int(first[d]) + min(start + 3 * stride, int(sizes[d]))]
            question, answer = (float(np.isin(x, passage).mean()) for x in (item.question, item.answer))
            if question < overlap or answer < overlap:
                continue
            n = min(SHINGLE, len(item.words))
            mine = shingles_of(item.words, n)
            whole = len(mine & shingles_of(passage, n)) / len(mine)
            if whole >= overlap and whole > best.get((d, c, j), {"overlap": -1})["overlap"]:
                best[d, c, j] = {"item_id": item.item_id, "score": score, "overlap": whole, "question_overlap": question, "answer_overlap": answer}
    for (d, _, _), leak in sorted(best.items(), key=lambda x: (x[0][0], _by_id(x[1]["item_id"]), x[0])):
        out[d].append(leak)
    return out


def _described(batches):
    """Distinct words of each item, and a row without a word for its length."""
    for batch in batches:
        words, sizes = words_in(batch.column(0))
        item = np.repeat(np.arange(len(sizes)), sizes)
        coded = words.dictionary_encode()
        held = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, len(sizes)) + item)
        full = sizes[sizes > 0].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary.take(pa.array(held // max(1, len(sizes)))), pa.nulls(len(full), pa.string())]), pa.array(np.r_[np.zeros(len(held), np.int64), full])], ["word", "size"])


class Blocks:
    """The indexes of a benchmark, one for each block of items, made when they are asked for; blocks are dealt by a hash of the item."""

    def __init__(self, rows: DataFrame, blocks: int, threshold: float):
        self.rows, self.blocks, self.threshold = rows, blocks, threshold
        if blocks > 1:
            bounded_batches(rows.sparkSession)
            counts = rows.select("text").mapInArrow(_described, "word string, size long")
            self.counts = saved(counts.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "bm25-statistics")
            whole = self.counts.where("word is null").first()
            self.items, self.mean = (whole.n, whole["size"] / whole.n) if whole else (0, 0.0)

    def __len__(self) -> int:
        return self.blocks

    def __iter__(self):
        return map(self.index, range(self.blocks))

    def index(self, b: int) -> Index:
        if self.blocks == 1:
            return Index([tuple(r) for r in self.rows.collect()], threshold=self.threshold)
        mine = self.rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.blocks)) == b)
        words = mine.select("text").mapInArrow(_described, "word string, size long").where("word is not null").select("word").distinct()
        df = dict(self.counts.join(words, "word", "left_semi").select("word", "n").collect())  # words of one block
        return Index([tuple(r) for r in mine.collect()], threshold=self.threshold, statistics=Statistics(self.items, self.mean, df))


def build_index(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_items: int = BLOCK_ITEMS, threshold: float = THRESHOLD) -> Blocks:
    """An index for each block of about block_items items; an empty benchmark has one of none."""
    rows = benchmark.where(quoted(text_col).isNotNull()).select(quoted(id_col).cast("long").alias("item_id"), quoted(text_col).cast("string").alias("text"))
    return Blocks(rows, max(1, -(-rows.count() // block_items)), threshold)


_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def _pass(shared, place: int, name: str, overlap: float):
    """Leaks of one block, added to those of the blocks before, which are in the last column."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                leaks = find_leaks(shared.value, part.column(place), overlap)
                if part.num_columns and part.schema.names[-1] == name:
                    leaks = [a + b for a, b in zip(part.column(part.num_columns - 1).to_pylist(), leaks, strict=True)]
                    part = part.select(part.schema.names[:-1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaks, _LEAKS)], [*part.schema.names, name])

    return run


def with_leaks(docs: DataFrame, index: Blocks | list[Index], *, text_col: str = "text", leaks_col: str = "leaks", overlap: float = OVERLAP) -> DataFrame:
    """Add the list of leaked items to every row; one pass a block of items, no shuffle. The rows are written out after
    every PIPED passes, so that a core has no more than so many indexes at once."""
    bounded_batches(docs.sparkSession)
    docs = docs.select([quoted(c) for c in docs.columns if c.lower() != leaks_col.lower()])
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(leaks_col, T.ArrayType(LEAK))])
    for k, one in enumerate(index):
        shared = docs.sparkSession.sparkContext.broadcast(one)  # bounded by BLOCK_ITEMS
        docs = docs.mapInArrow(_pass(shared, place, leaks_col, overlap), schema)
        if k % PIPED == PIPED - 1 and k + 1 < len(index):
            docs = saved(docs, "leaks")
    return docs


def leaked_pairs(docs: DataFrame, index: Blocks | list[Index], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that it leaks."""
    marked = with_leaks(docs.select(id_col, text_col), index, text_col=text_col, leaks_col="_leaks")
    return marked.select(id_col, F.explode("_leaks").alias("_leak")).select(id_col, "_leak.*")
