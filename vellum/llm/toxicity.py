"""Toxicity scoring behind a noisy-channel deobfuscator.

Restoring: a token that looks disguised (leetspeak, separators inside, letters repeated three times or more,
symbols only) becomes a lattice. Each character may stay, become a letter it
stands for, or vanish if it is a separator or repeats the letter before; each choice has a channel cost.
Viterbi finds the path with the least channel cost plus code length under a character 4-gram model. The
model is counted over every text of the corpus: a dense table over 28 classes, so its size is fixed.
Words that spaces cut are a lattice too, whose arcs drop a space between neighbouring short tokens: letters spaced out
one by one, and pieces of up to PIECE letters that together spell a learned word, where the model codes the word with
the spaces dropped in fewer bits than the pieces.

Scoring: a logistic model over how often, and how densely, the restored text has the learned words and word
beginnings. They are chosen by association with the label in a bounded sample of labelled training rows
(TRAIN_ROWS), at most FEATURES of them.

Defined cases: null texts count as empty and get the model's base rate; without training rows of both
labels every score is the share of label 1 (0 without rows); of a document's repeated labels the largest
counts; repeated rows are scored each; texts and tokens of any length go whole, in time that grows with their length
(a path is settled as soon as all that lead on share it); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, spans_to_index, text_bytes

#: Bound of the labelled sample; the rows are chosen by a hash of the id.
TRAIN_ROWS = 20_000
FEATURES = 2000
#: Least log-likelihood ratio (G) for a word to become a feature.
LEAST_G = 30.0
#: Word beginnings of these lengths are candidates beside whole words.
PREFIXES = (4, 5, 6, 7)
CLASSES = 28
_OTHER = 27

#: Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou",
}
_SEPARATORS = set("._-*~'`,:;/\\^=​­")
KEEP, STAND, DROP, AGAIN, UNSPACE = 0.1, 2.0, 1.0, 1.5, 3.0
#: Letters of a piece of a word that spaces cut, and the least and most pieces' letters that are looked for.
PIECE, LEAST_CUT, MOST_CUT = 3, 4, 24
#: Characters after which settled parts of a path are written out, and the longest token whose result is kept.
_SETTLE, _KEPT = 512, 64

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[192:] = _OTHER  # lead bytes of letters beyond ASCII
_TRAIL = np.zeros(256, bool)
_TRAIL[128:192] = True

_ODD = re.compile(r"[^\W\d_]")
_DISGUISED = re.compile(r"[0-9@$!|+(*#€._\-~'`,:;/\\^=​­]|([^\W\d_])\1\1")
_EDGES = ".,;:?!\"'`*%&#~^=|/\\()[]{}<>-_+"


def _class_of(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else _OTHER


def gram_counts(array: pa.Array) -> np.ndarray:
    """Counts of all class 4-grams of the texts, dense."""
    data, offsets = text_bytes(pc.utf8_lower(array))
    keep = ~_TRAIL[data]
    code = _CLASS[data]
    # a separator at each text's start keeps texts apart; runs of separators become one
    if len(data):
        code = np.insert(code[keep], np.concatenate([[0], np.cumsum(keep)])[offsets[:-1]], 0)
    code = code[(code != 0) | np.concatenate([[True], code[:-1] != 0])] if len(code) else code
    code = np.concatenate([np.zeros(3, np.uint8), code, np.zeros(1, np.uint8)]).astype(np.int32)
    grams = ((code[:-3] * CLASSES + code[1:-2]) * CLASSES + code[2:-1]) * CLASSES + code[3:]
    return np.bincount(grams, minlength=CLASSES**4)


def _count_grams(batches):
    total = np.zeros(CLASSES**4, np.int64)
    for batch in batches:
        total += gram_counts(batch.column(0))
    at = np.flatnonzero(total)
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000].astype(np.int32)), pa.array(total[at[i : i + 50_000]])], ["gram", "n"])


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of the last class of each 4-gram, shorter contexts blended in as pseudo-counts."""
    shape = (CLASSES,) * 4
    n = counts.reshape(shape).astype(float)
    p = np.full(shape[:1], 1 / CLASSES)
    for width in range(1, 5):
        c = n.sum(axis=tuple(range(4 - width)))
        p = (c + 4.0 * p) / (c.sum(-1, keepdims=True) + 4.0)
    return -np.log2(p).ravel().astype(np.float32)


def train_language_model(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Character model over all texts; the driver gets at most CLASSES**4 sums."""
    counts = np.zeros(CLASSES**4, np.int64)
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    return code_lengths(counts)


class Restorer:
    """Viterbi over the lattice of one token at a time; results are kept for repeated tokens."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.tolist()
        self.seen: dict[str, str] = {}

    @staticmethod
    def options(token: str, i: int) -> list[tuple[str, float]]:
        c = token[i]
        out = []
        if c.isalpha():
            out.append((c, KEEP))
            if i and token[i - 1] == c and (token[i - 2 : i] == c * 2 or token[i + 1 : i + 2] == c):
                out.append(("", AGAIN))  # in runs of three or more
        else:
            out += [(x, STAND + math.log2(len(LEET[c]))) for x in LEET.get(c, "")]
            if c in _SEPARATORS or not out:
                out.append(("", DROP))
            elif i and token[i - 1] == c:
                out.append(("", AGAIN))
        return out

    def restore(self, token: str) -> str:
        """The cheapest reading; of equally cheap ones the path whose steps sort first."""
        if (known := self.seen.get(token)) is not None:
            return known
        bits, n3 = self.bits, CLASSES**3
        paths = {0: 0.0}  # cost by the last three classes
        steps: list[dict[int, tuple[str, int]]] = []  # for each character and state, what was read and the state before
        out: list[str] = []
        for i in range(len(token)):
            new: dict[int, float] = {}
            step: dict[int, tuple[str, int]] = {}
            for x, cost in self.options(token, i):
                k = _class_of(x) if x else 0
                for state, old in paths.items():
                    if x:
                        at = state * CLASSES + k
                        total, to = old + cost + bits[at], at % n3
                    else:
                        total, to = old + cost, state
                    if to not in new or total < new[to] or (total == new[to] and (x, state) < step[to]):
                        new[to], step[to] = total, (x, state)
            paths = new
            steps.append(step)
            if len(steps) >= 2 * _SETTLE and len(steps) % _SETTLE == 0:
                # where all live paths come from one state, what is before is settled
                live, at = set(paths), len(steps)
                while at and len(live) > 1:
                    at -= 1
                    live = {steps[at][s][1] for s in live}
                if at:
                    out.append(self._read(steps[:at], live.pop()))
                    steps = steps[at:]
        last = min((cost + bits[state * CLASSES], state) for state, cost in paths.items())[1]
        best = "".join(out) + self._read(steps, last)
        if len(self.seen) > 200_000:
            self.seen.clear()
        if len(token) <= _KEPT:
            self.seen[token] = best
        return best

    @staticmethod
    def _read(steps: list[dict[int, tuple[str, int]]], state: int) -> str:
        said = []
        for step in reversed(steps):
            x, state = step[state]
            said.append(x)
        return "".join(reversed(said))

    def unspaced(self, pieces: list[str]) -> bool:
        """Whether the cheapest path over the lattice of the pieces, whose spaces may each be dropped, drops them all."""
        paths = {0: (0.0, 0)}  # cost and spaces kept, by the last three classes
        for n, piece in enumerate(pieces):
            arcs = [[(0, KEEP, 1), (None, UNSPACE, 0)]] if n else []
            for options in (*arcs, *([(_class_of(c), KEEP, 0)] for c in piece)):
                new: dict[int, tuple[float, int]] = {}
                for state, (old, kept) in paths.items():
                    for k, cost, more in options:
                        at = state * CLASSES + (k or 0)
                        total = (old + cost, kept + more) if k is None else (old + cost + self.bits[at], kept + more)
                        to = state if k is None else at % CLASSES**3
                        new[to] = min(new.get(to, total), total)
                paths = new
        return min((cost + self.bits[state * CLASSES], kept) for state, (cost, kept) in paths.items())[1] == 0


def core_of(token: str) -> str:
    """The token without punctuation around it; $, @ and + in front may stand for letters, as may all of a token of such
    characters only."""
    if len(token) >= LEAST_CUT and not token.isdigit() and all(c in LEET for c in token) and len(set(token)) > 2:
        return token
    return token.rstrip(_EDGES + "$@").lstrip(_EDGES.replace("+", ""))


def names_of(word: str) -> list[str]:
    """Feature names of a restored word: itself and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def disguised(core: str) -> bool:
    """Letters with signs of disguise, or no letter but characters that all stand for one (numbers of three digits too)."""
    return bool(_DISGUISED.search(core)) and (bool(_ODD.search(core)) or (len(core) >= 3 and all(c in LEET for c in core)))


class Words:
    """Restored words of texts, as sets of indices into a vocabulary."""

    def __init__(self, bits: np.ndarray, vocabulary: list[str] | None = None):
        self.restorer = Restorer(bits)
        self.place = None if vocabulary is None else {w: i for i, w in enumerate(vocabulary)}
        whole = [w for w in vocabulary or () if not w.endswith("*")]
        self.lengths = sorted({len(w) for w in whole if len(w) >= 3})
        #: Beginnings of the words that may have been cut.
        self.cut = {w for w in whole if LEAST_CUT <= len(w) <= MOST_CUT and w.isalpha()}
        self.begun = {w[:i] for w in self.cut for i in range(len(w) + 1)}
        self.joins: dict[tuple[str, str], bool] = {}

    def of_tokens(self, tokens: list[str]) -> list[str]:
        out = []
        for token in tokens:
            core = core_of(token)
            out.append(self.restorer.restore(core) if core and disguised(core) else core)
        return out

    def spaced(self, run: str) -> set[str]:
        """Known words inside letters that were spaced out."""
        text = self.restorer.restore(run) if disguised(run) else run
        return {w for n in self.lengths for i in range(len(text) - n + 1) if (w := text[i : i + n]) in self.place}

    def readings(self, piece: str, begun: set[str]) -> set[str]:
        """What begins a learned word: each of the beginnings with a reading of the piece after it."""
        for i in range(len(piece)):
            begun = {w for x, _ in Restorer.options(piece, i) for y in begun if (w := y + x) in self.begun}
        return begun

    def _opens(self, a: str, b: str) -> bool:
        """Whether two pieces may begin a cut word."""
        if (known := self.joins.get((a, b))) is None:
            known = bool(self.readings(b, self.readings(a, {""})) - {""})
            if len(self.joins) > 500_000:
                self.joins.clear()
            self.joins[a, b] = known
        return known

    def mended(self, row: np.ndarray, number: np.ndarray, cores: list[str]) -> list[tuple[int, str]]:
        """(row, word) of learned words that spaces cut into neighbouring pieces of up to PIECE letters."""
        short = np.array([0 < len(c) <= PIECE for c in cores], bool)[number] if len(number) else np.zeros(0, bool)
        at = np.flatnonzero(short[:-1] & short[1:] & (row[:-1] == row[1:])) if len(row) > 1 else np.zeros(0, np.int64)
        if not len(at) or not self.cut:
            return []
        pairs, inverse = np.unique(number[at] * len(cores) + number[at + 1], return_inverse=True)
        opens = np.array([self._opens(cores[p // len(cores)], cores[p % len(cores)]) for p in pairs.tolist()], bool)
        found = []
        for i in at[opens[inverse]].tolist():
            begun, j = {""}, i
            ends: dict[str, list[str]] = {"": []}  # the pieces of each beginning, as they are read
            while begun and j < len(row) and row[j] == row[i] and short[j]:
                new: dict[str, list[str]] = {}
                for start in begun:
                    for w in self.readings(cores[number[j]], {start}) - {start}:
                        new.setdefault(w, [*ends[start], w[len(start) :]])
                begun, ends = set(new), new
                found += [(int(row[i]), w) for w in sorted(begun & self.cut) if len(ends[w]) > 1 and self.restorer.unspaced(ends[w])]
                j += 1
        return found

    def tokens(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Row and distinct-token number of every token, and the distinct tokens."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(array.fill_null("")))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        coded = lists.flatten().dictionary_encode()
        row, number = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), coded.indices.to_numpy(zero_copy_only=False)
        filled = np.array([bool(t) for t in coded.dictionary.to_pylist()], bool)
        keep = filled[number] if len(number) else np.zeros(0, bool)
        return row[keep], number[keep], coded.dictionary.to_pylist()

    def features(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and vocabulary indices that occur, how often, and the number of tokens of each text."""
        row, number, distinct = self.tokens(array)
        width, get = len(self.place) + 1, self.place.get
        lists = [[i for name in names_of(w) if (i := get(name, -1)) >= 0] if w else [] for w in self.of_tokens(distinct)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(size.sum()))
        hit = np.flatnonzero(size[number]) if len(number) else np.zeros(0, np.int64)
        n = size[number[hit]]
        found = [np.repeat(row[hit], n) * width + flat[spans_to_index((np.cumsum(size) - size)[number[hit]], n)]]
        short = np.array([len(t.strip(".,;:?\"'")) == 1 for t in distinct], bool)
        for a, b in self.runs(row, short[number] if len(number) else short):
            word = "".join(distinct[k].strip(".,;:?\"'") for k in number[a:b])
            found.append(np.array([row[a] * width + i for w in self.spaced(word) for name in names_of(w) if (i := get(name, -1)) >= 0], np.int64))
        cores = [t if len(t) <= PIECE and all(c in LEET for c in t) else core_of(t) for t in distinct]
        found.append(np.array([r * width + i for r, w in self.mended(row, number, cores) for name in names_of(w) if (i := get(name, -1)) >= 0], np.int64))
        pairs, count = np.unique(np.concatenate(found), return_counts=True)
        return pairs // width, pairs % width, count, np.bincount(row, minlength=len(array))

    @staticmethod
    def runs(row: np.ndarray, short: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of three or more one-character tokens in a text."""
        at = np.flatnonzero(short)
        if len(at) < 3:
            return []
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])) + 1
        bounds = [0, *cut.tolist(), len(at)]
        return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a >= 3]


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, target: str, rows: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, text) of about `rows` usable labelled rows, by a hash of the id. Only the sampled labels, at most
    a few more than `rows`, are broadcast; the texts stay where they are."""
    known = labels.where(usable & F.col(id_col).isNotNull() & F.col(target).isNotNull()).groupBy(id_col).agg((F.max(target) > 0).cast("int").alias("y"))
    n = known.count()
    share = min(1 << 20, int(rows / max(1, n) * (1 << 20)) + 1)
    picked = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(1 << 20)) < share).limit(2 * rows)
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), id_col).select("y", "text")


def design(row: np.ndarray, index: np.ndarray, count: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse design: the logarithm of each count, and in a second block its density in the text."""
    density = np.minimum(20 * count / np.maximum(size[row], 1), 2.0)
    return np.tile(row, 2), np.concatenate([index, index + width]), np.concatenate([np.log1p(count), density])


class Model:
    def __init__(self, bits: np.ndarray, vocabulary: list[str], weights: np.ndarray, bias: float):
        self.bits, self.vocabulary, self.weights, self.bias = bits, vocabulary, weights, bias

    def scores(self, array: pa.Array, words: Words) -> np.ndarray:
        row, index, value = design(*words.features(array), len(self.vocabulary))
        z = self.bias + np.bincount(row, self.weights[index] * value, len(array)) if len(row) else np.full(len(array), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(y: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray, width: int, *, l2: float = 0.01, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse features by gradient descent with a step of its own for each weight."""
    n = len(y)
    w, b = np.zeros(width), 0.0
    g2, gb2 = np.full(width, 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(row, w[index] * value, n)
        d = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        g = np.bincount(index, d[row] * value, width) + l2 * w
        g2 += g * g
        gb2 += d.sum() ** 2
        w -= g / np.sqrt(g2)
        b -= d.sum() / np.sqrt(gb2)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    bits = train_language_model(docs, text_col=text_col)
    shared = spark.sparkContext.broadcast(bits)
    sample = labelled_sample(docs, labels, usable, target, rows, id_col=id_col, text_col=text_col)

    def count(batches):
        words = Words(shared.value)
        total: dict[str, list[int]] = {}
        size = [0, 0]
        for batch in batches:
            y = batch.column(0).to_numpy()
            size[0] += int((y == 0).sum())
            size[1] += int((y == 1).sum())
            row, number, distinct = words.tokens(batch.column(1))
            seen: dict[str, int] = {}
            lists = [[seen.setdefault(name, len(seen)) for name in names_of(w)] if w else [] for w in words.of_tokens(distinct)]
            names = list(seen)
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for x in lists for i in x), np.int64, int(n.sum()))
            once = np.unique(row * max(1, len(distinct)) + number)
            row, number = once // max(1, len(distinct)), once % max(1, len(distinct))
            pair = np.unique(np.repeat(row, n[number]) * max(1, len(names)) + flat[spans_to_index((np.cumsum(n) - n)[number], n[number])])
            r, k = pair // max(1, len(names)), pair % max(1, len(names))
            for j in (0, 1):
                for i, c in enumerate(np.bincount(k[y[r] == j], minlength=len(names)).tolist()):
                    if c:
                        total.setdefault(names[i], [0, 0])[j] += c
        total[""] = size
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], ["word", "n0", "n1"])

    counts = sample.mapInArrow(count, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    size = counts.where("word = ''").agg(F.sum("n0"), F.sum("n1")).first()
    n0, n1 = size[0] or 0, size[1] or 0
    if not n0 or not n1:
        counts.unpersist()
        p = min(max(n1 / max(1, n0 + n1), 1e-9), 1 - 1e-9)
        return Model(bits, [], np.zeros(0), math.log(p / (1 - p)))
    both, rest = F.col("n0") + F.col("n1"), F.lit(n0 + n1)
    term = lambda seen, total: F.when(seen > 0, seen * F.log(seen * rest / (both * total))).otherwise(0.0)
    miss = lambda seen, total: F.when(total > seen, (total - seen) * F.log((total - seen) * rest / ((rest - both) * total))).otherwise(0.0)
    g = 2 * (term(F.col("n0"), F.lit(n0)) + term(F.col("n1"), F.lit(n1)) + miss(F.col("n0"), F.lit(n0)) + miss(F.col("n1"), F.lit(n1)))
    chosen = counts.where((F.length("word") >= 2) & (both >= 4)).withColumn("g", g).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "word").limit(FEATURES).select("word").collect()
    counts.unpersist()
    vocabulary = sorted(r[0] for r in chosen)

    def rows_of(batches):
        words = Words(shared.value, vocabulary)
        for batch in batches:
            row, index, count, size = words.features(batch.column(1))
            cut = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (index, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(size)], ["y", "words", "counts", "size"])

    got = sample.mapInArrow(rows_of, "y int, words array<int>, counts array<int>, size long").collect()
    y, size = np.array([r[0] for r in got], float), np.array([r[3] for r in got])
    row = np.repeat(np.arange(len(got)), [len(r[1]) for r in got])
    index, count = (np.array([w for r in got for w in r[j]], np.int64) for j in (1, 2))
    row, index, value = design(row, index, count, size, len(vocabulary))
    weights, bias = fit_logistic(y, row, index, value, 2 * len(vocabulary))
    return Model(bits, vocabulary, weights, bias)


def with_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by CLASSES**4 and FEATURES

    def run(batches):
        words = Words(shared.value.bits, shared.value.vocabulary)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 2000):
                part = batch.slice(at, 2000)
                score = shared.value.scores(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
