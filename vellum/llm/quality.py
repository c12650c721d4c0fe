"""Quality scoring by a generalised additive model with pairwise interactions.

A document is described by ratios and counts over its whole text. Cyclic boosting visits one feature after
the other, each time fitting a shallow tree (up to four leaves) on that feature's bins and adding its
damped leaves to the feature's lookup table; then the same for the pairs of features whose cut in four
explains most of what is left. A score is the sum of table entries at the document's bins, through a logistic.

Defined cases: null texts count as empty, and empty texts have zero for every feature; infinite values do
not arise; without training rows of both labels every score is the share of label 1 (0.5 without rows);
repeated rows are scored each; very long texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_bytes
from .toxicity import labelled_sample

TRAIN_ROWS = 20_000
BINS = 48
PAIR_BINS = 10
PAIRS = 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
THRESHOLD = 0.7

NAMES = ("log_bytes", "mean_word", "upper", "digit", "symbol", "bang", "bar", "stop", "comma", "line", "wide", "distinct_words", "distinct_lines", "packed", "long_words", "one_letter", "top_word", "colon", "top_line_share")

_KIND = np.zeros((10, 256), bool)
for _row, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "*%&#$@~^_+=<>{}\\", "!", "|", ".?", ",;", "\n", "", ":/")):
    _KIND[_row, [ord(c) for c in _chars]] = True
_KIND[8, 128:192] = True  # trailing bytes: letters beyond ASCII


def features(array: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    data, offsets = text_bytes(array)
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    full = np.flatnonzero(size)
    for j, kind in enumerate(_KIND):
        out[full, 2 + j] = np.add.reduceat(kind[data].astype(np.int32), offsets[full]) / size[full]
    out[:, 0] = np.log1p(size)
    squeeze = zstandard.ZstdCompressor(level=1)
    raw = data.tobytes()
    # columns 2..10 hold the byte kinds; the last of them moves to make room for the word features
    out[:, 17] = out[:, 11]
    out[:, 11] = 0
    for i in full.tolist():
        text = raw[offsets[i] : offsets[i + 1]]
        words, lines = text.split(), [x for x in text.split(b"\n") if x]
        k = len(words)
        out[i, 13] = len(squeeze.compress(text)) / len(text)
        if not k:
            continue
        lengths = np.fromiter(map(len, words), np.int64, k)
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        out[i, 1] = lengths.mean()
        out[i, 11] = len(counts) / k
        out[i, 12] = len(set(lines)) / len(lines)
        out[i, 14] = (lengths > 15).mean()
        out[i, 15] = (lengths == 1).mean()
        out[i, 16] = max(counts.values()) / k
        out[i, 18] = max(map(len, lines)) / len(text)
    return out


def _cut(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most `bins` bins of about equal weight."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, least: float) -> int:
    """Best cut of a run of bins into two, or 0."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0
    rg, rh = g.sum() - cg, h.sum() - ch
    gain = np.where((ch >= least) & (rh >= least), cg**2 / (ch + 1) + rg**2 / (rh + 1), -1)
    best = int(gain.argmax())
    return best + 1 if gain[best] > g.sum() ** 2 / (h.sum() + 1) + 1e-9 else 0


def shallow_tree(g: np.ndarray, h: np.ndarray, least: float = 2.0) -> np.ndarray:
    """Leaf values for each bin: a tree of depth two over the ordered bins."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    middle = _split(g, h, least)
    for a, b in ((0, middle), (middle, len(g))) if middle else ():
        inner = _split(g[a:b], h[a:b], least)
        for x, y in ((a, a + inner), (a + inner, b)) if inner else ((a, b),):
            out[x:y] = _leaf(g[x:y].sum(), h[x:y].sum())
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of a grid of bins into four by one cut an axis: gain and leaf values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = [_leaf(x[i, j], y[i, j]) for x, y in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf[0], leaf[1], leaf[2], leaf[3]
    return float(gain[i, j]), out


class AdditiveModel:
    """Lookup tables over bins: one a feature, one for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        width = x.shape[1]
        self.edges = [_cut(x[:, j], BINS) if len(y) else np.zeros(0) for j in range(width)]
        self.coarse = [_cut(x[:, j], PAIR_BINS) if len(y) else np.zeros(0) for j in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not len(y) or y.min() == y.max():
            return
        bins = [np.searchsorted(self.edges[j], x[:, j], "right") for j in range(width)]
        z = np.full(len(y), self.bias)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j in range(width):
                g, h = slopes()
                n = len(self.tables[j])
                step = RATE * shallow_tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
                self.tables[j] += step
                z += step[bins[j]]
        coarse = [np.searchsorted(self.coarse[j], x[:, j], "right") for j in range(width)]
        sizes = [len(c) + 1 for c in self.coarse]
        grid = lambda i, j, v: np.bincount(coarse[i] * sizes[j] + coarse[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
        g, h = slopes()
        candidates = [(i, j) for i in range(width) for j in range(i) if sizes[i] > 1 and sizes[j] > 1]
        ranked = sorted(candidates, key=lambda p: -quadrants(grid(*p, g), grid(*p, h))[0])[:PAIRS]
        tables = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in ranked}
        for _ in range(PAIR_ROUNDS):
            for i, j in ranked:
                g, h = slopes()
                step = RATE * quadrants(grid(i, j, g), grid(i, j, h))[1]
                tables[i, j] += step
                z += step[coarse[i], coarse[j]]
        self.pairs = [(i, j, t) for (i, j), t in tables.items()]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (edges, entries) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += entries[np.searchsorted(edges, x[:, j], "right")]
        coarse = [np.searchsorted(self.coarse[j], x[:, j], "right") for j in range(x.shape[1])]
        for i, j, entries in self.pairs:
            z += entries[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _describe(batches):
    for batch in batches:
        x = features(batch.column(1).fill_null(""))
        cut = np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(x.ravel()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> AdditiveModel:
    bounded_batches(docs.sparkSession)
    got = labelled_sample(docs, labels, usable, target, rows, id_col=id_col, text_col=text_col).mapInArrow(_describe, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(NAMES)) if len(y) else np.zeros((0, len(NAMES)))
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    return AdditiveModel(x[order], y[order])


def with_quality(docs: DataFrame, model: AdditiveModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of tables of at most BINS or PAIR_BINS**2 entries

    def run(batches):
        for batch in batches:
            score = shared.value.scores(features(batch.column(1).fill_null("")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
