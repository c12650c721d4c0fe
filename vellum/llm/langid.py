"""Language identification by prediction by partial matching over bytes.

For each language a context tree of up to ORDER preceding bytes is counted from a bounded number of its
training rows, whole texts, in the executors, and then frozen. A byte's code length follows the classical escape rule (method C): in a
context with n occurrences of u distinct bytes, a byte seen c times costs log2((n + u) / c); an unseen
one costs log2((n + u) / u) and is coded in the next shorter context, at last uniformly over 256.
There is no update and no exclusion while scoring, so a byte's cost is a fixed function of the bytes
before it: the contexts of all languages are merged into one table an order, with a vector of code
lengths for each, and whole batches are scored by table lookups. The language with the shortest code is
predicted; the score is its posterior probability under the code lengths.

Texts are lower-cased, and runs of ASCII non-letters become one space, before coding: code lengths are exact for
that folded text.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the language
that sorts first; with no training rows everything is `und`; repeated rows count each time; very long texts are coded
whole, in steps. Other columns pass through; one that has the name of an output column, in whatever case, gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, quoted, text_bytes
from .numeric import HashIndex, summed

ORDER = 4
#: The bound of the sample: about so many training rows a language; and of the languages, each a column of every table.
SAMPLE_ROWS, MAX_LANGS = 400, 1000
UND = "und"
_SEP = 0x20
#: Bytes scored at a time.
_STEP = 1 << 18
#: Code lengths of a garbled text exceed this many bits a byte in every language.
MAX_BITS = 7.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = _SEP
_FOLD[97:123] = np.arange(97, 123)


def coded_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes with ORDER separators before each text, the starts of the texts, and their lengths."""
    data, offsets = text_bytes(pc.utf8_lower(array))
    data = _FOLD[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    keep = (data != _SEP) | np.concatenate([[True], data[:-1] != _SEP]) | first if len(data) else np.zeros(0, bool)
    lengths = np.diff(np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[offsets]).astype(np.int64)
    data = data[keep]
    starts = np.cumsum(lengths) - lengths + ORDER * (np.arange(len(lengths)) + 1)
    pad = np.zeros(len(data) + ORDER * len(lengths), bool)
    pad[(starts[:, None] - np.arange(1, ORDER + 1)).ravel()] = True
    out = np.full(len(pad), _SEP, np.uint8)
    out[~pad] = data
    return out, starts, lengths


def _grams(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The last `width` bytes up to and with each place, as integers."""
    out = np.zeros(len(at), np.uint64)
    for back in range(width - 1, -1, -1):
        out = (out << np.uint64(8)) | data[at - back].astype(np.uint64)
    return out


def gram_counts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of ORDER + 1 folded bytes, as integers, and how often each occurs."""
    data, starts, lengths = coded_bytes(array)
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    parts = [np.unique(_grams(data, at[i : i + _STEP], ORDER + 1), return_counts=True) for i in range(0, len(at), _STEP)]
    return summed(parts)


class ContextTrees:
    """Frozen trees of all languages: for each order the strings seen, with a code length per language."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: for each language its strings of ORDER + 1 bytes, sorted, and their counts. Shorter strings are their ends,
        since every coded byte has ORDER bytes before it."""
        self.langs = sorted(grams)
        self.tables: list[tuple[HashIndex, np.ndarray]] = []
        self.escapes: list[tuple[HashIndex, np.ndarray]] = []
        if not self.langs:
            return
        ends = [np.uint64((1 << (8 * (order + 1))) - 1) for order in range(ORDER + 1)]
        counts = [[summed([(grams[lang][0] & end, grams[lang][1])]) for lang in self.langs] for end in ends]
        n = len(self.langs)
        for order in range(ORDER + 1):
            contexts = np.unique(np.concatenate([k >> np.uint64(8) for k, _ in counts[order]]))
            escapes = np.zeros((len(contexts), n), np.float32)
            totals = np.zeros((len(contexts), n))
            for j, (keys, c) in enumerate(counts[order]):
                at = np.searchsorted(contexts, keys >> np.uint64(8))
                total, distinct = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = distinct > 0
                totals[:, j] = total + distinct
                escapes[seen, j] = np.log2((total + distinct)[seen] / distinct[seen])
            self.escapes.append((HashIndex(contexts), escapes))
            keys = np.unique(np.concatenate([k for k, _ in counts[order]]))
            shorter = self.cost(keys & np.uint64((1 << (8 * order)) - 1), order - 1)
            at = np.searchsorted(contexts, keys >> np.uint64(8))
            code = escapes[at] + shorter
            for j, (own, c) in enumerate(counts[order]):
                place = np.searchsorted(keys, own)
                code[place, j] = np.log2(totals[at[place], j] / c)
            self.tables.append((HashIndex(keys), code.astype(np.float32)))

    def cost(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Code lengths, per language, of the last byte of each gram in the context of the bytes before it."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        index, code = self.tables[order]
        found = index.find(grams)
        out = code[found] if len(code) else np.zeros((len(grams), len(self.langs)), np.float32)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            rest = grams[lost]
            down = self.cost(rest & np.uint64((1 << (8 * order)) - 1), order - 1)
            index, escapes = self.escapes[order]
            at = index.find(rest >> np.uint64(8))
            if len(escapes):
                down = down + np.where((at >= 0)[:, None], escapes[at], np.float32(0))
            out[lost] = down
        return out

    def bits(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Total code length of each text in each language, and the number of bytes coded."""
        data, starts, lengths = coded_bytes(array)
        total = np.zeros((len(lengths), len(self.langs)))
        ends = np.cumsum(lengths)
        for begin in range(0, int(lengths.sum()) if self.langs else 0, _STEP):  # in steps, however long a text is
            place = np.arange(begin, min(begin + _STEP, ends[-1]))
            who = np.searchsorted(ends, place, "right")
            cost = self.cost(_grams(data, place + ORDER * (who + 1), ORDER + 1), ORDER)
            heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            for j in range(len(self.langs)):
                total[who[heads], j] += np.add.reduceat(cost[:, j], heads, dtype=np.float64)
        return total, lengths

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior and bits a byte of each text."""
        total, lengths = self.bits(array)
        letter = pc.fill_null(pc.match_substring_regex(array, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return [UND] * len(lengths), np.zeros(len(lengths)), np.zeros(len(lengths))
        best = total.argmin(1)
        low = total[np.arange(len(total)), best]
        posterior = 1 / np.exp2(-np.minimum(total - low[:, None], 1000)).sum(1)
        known = letter & (lengths > 0)
        langs = [self.langs[b] if k else UND for b, k in zip(best, known, strict=True)]
        return langs, np.where(known, posterior, 0.0), np.where(known, low / np.maximum(lengths, 1), 0.0)


    @classmethod
    def of_texts(cls, samples: dict[str, list[str]]) -> ContextTrees:
        return cls({lang: gram_counts(pa.array(texts, pa.string())) for lang, texts in samples.items()})


def _count(batches):
    found: dict[str, list] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            parts = found.setdefault(lang, [])
            parts.append(gram_counts(batch.column(1).filter(pc.equal(langs.indices, k))))
            found[lang] = [summed(parts)] if len(parts) > 8 else parts
    for lang, parts in found.items():
        keys, counts = summed(parts)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[at : at + 50_000])], ["lang", "gram", "n"])


def train(docs: DataFrame, usable: Column, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> ContextTrees:
    """Trees from about `rows` rows of each language among the usable ones, chosen by a hash of the id. Executors count; the
    driver gets the distinct strings of the sample. Over MAX_LANGS languages are refused."""
    bounded_batches(docs.sparkSession)
    ready = docs.where(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(17)).alias("luck"))
    sizes = {r[0]: r[1] for r in ready.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if not sizes:
        return ContextTrees({})
    shares = docs.sparkSession.createDataFrame([(lang, min(1 << 20, int(rows / n * (1 << 20)) + 1)) for lang, n in sizes.items()], "lang string, share long")
    picked = ready.join(F.broadcast(shares), "lang").where(F.pmod("luck", F.lit(1 << 20)) < F.col("share")).select("lang", "text")
    got = picked.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, keys, counts = got.column("lang").combine_chunks(), got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    mine = {lang: pc.equal(langs, lang).to_numpy(zero_copy_only=False) for lang in pc.unique(langs).to_pylist()}
    return ContextTrees({lang: summed([(keys[at], counts[at])]) for lang, at in mine.items()})


def with_language(docs: DataFrame, trees: ContextTrees, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", bits_col: str = "bits_per_byte") -> DataFrame:
    """Add the predicted language, its score and its code length a byte to every row; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    docs = docs.select([quoted(c) for c in docs.columns if c.lower() not in (pred_col.lower(), score_col.lower(), bits_col.lower())])
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample's bytes

    def run(batches):
        for batch in batches:
            langs, score, bits = shared.value.predict(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], [*batch.schema.names, pred_col, score_col, bits_col])

    added = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType()), T.StructField(bits_col, T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(run, schema)


def rejected(pred_col: str = "lang_pred", bits_col: str = "bits_per_byte") -> Column:
    """Documents in no learned language: no letter at all, or no shorter to code than noise."""
    return (F.col(pred_col) == UND) | (F.col(bits_col) > MAX_BITS)
