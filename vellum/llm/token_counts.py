"""Delta-maintained token rollups.

Totals by source, language and tokenizer version are additive, so a batch of changes is a set of signed
rows: an insert adds a document's count, a delete takes it away, a revised count does both. A batch is
summed by key, written under a name of its own, and becomes part of the totals when its commit record
appears. A record is made by renaming a finished file to `<batch>.json`, which fails if one is there: a
batch that is sent again, or by two drivers at once, counts once. Totals are the sum of committed deltas;
compact() folds them into a base in the same way.

Defined cases: null source and language are keys of their own; a null text has no tokens and counts as a
document; repeated rows count each time they are inserted; totals whose documents and tokens are all zero
are left out; other columns pass through, and one named as a count gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, quoted

#: Fixed value: the pattern by which the byte-level vocabularies split texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

_encodings: dict[tuple[str, bytes], object] = {}


def read_vocabulary(path: str) -> bytes:
    """The driver reads the file; executors get it by broadcast (about a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encoding(name: str, vocabulary: bytes):
    """The encoder of a vocabulary, built once in a process; vocabularies are told apart by their content."""
    import tiktoken

    key = (name, hashlib.sha256(vocabulary).digest())
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def with_token_counts(docs: DataFrame, vocabularies: dict[str, bytes], *, text_col: str = "text", prefix: str = "n_", also: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Every column but the texts, and a column <prefix><tokenizer> for each vocabulary; one pass, no shuffle.

    also: {new column: (tokenizer, text column)} for other texts of the same row, counted in the same pass. An executor
    then has one set of encoders a core, however many texts a row has.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)
    wanted = {f"{prefix}{v}": (v, text_col) for v in vocabularies} | (also or {})
    texts = list(dict.fromkeys(t for _, t in wanted.values()))
    rest = [c for c in docs.columns if c not in texts and c.lower() not in {n.lower() for n in wanted}]

    def run(batches):
        encoders = {k: encoding(k, v) for k, v in shared.value.items()}
        by_text = {t: [(j, encoders[v]) for j, (v, own) in enumerate(wanted.values()) if own == t] for t in texts}
        for batch in batches:
            counts = np.zeros((len(wanted), batch.num_rows), np.int64)
            for k, t in enumerate(texts):
                for i, text in enumerate(batch.column(len(rest) + k)):
                    if text := text.as_py():
                        for j, e in by_text[t]:
                            counts[j, i] = len(e.encode_ordinary(text))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *map(pa.array, counts)], [*rest, *wanted])

    docs = docs.select(*map(quoted, [*rest, *texts]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[: len(rest)], *(T.StructField(name, T.LongType()) for name in wanted)]))


def change(counts: DataFrame, sign: int | Column, tokenizer: str, tokens: str, chars: str = "n_chars") -> DataFrame:
    """Signed rows of an insert (1) or a delete (-1)."""
    s = F.lit(sign) if isinstance(sign, int) else sign
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), s.cast("long").alias("n_docs"), (s * F.col(tokens)).cast("long").alias("n_tokens"), (s * F.coalesce(chars, F.lit(0))).cast("long").alias("n_chars"))


def revision(counts: DataFrame, tokenizer: str, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Signed rows of revised counts: (tokens, chars) columns before and after. Documents stay as many."""
    diff = lambda i: (F.coalesce(new[i], F.lit(0)) - F.coalesce(old[i], F.lit(0))).cast("long")
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), diff(0).alias("n_tokens"), diff(1).alias("n_chars"))


class Rollup:
    """Totals in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._files.mkdirs(self._path(f"{self.path}/commits"))

    def _publish(self, name: str, record: dict) -> bool:
        """Create commits/<name>.json unless it is there; whole or not at all."""
        jvm = self.spark._jvm
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        target = self._path(f"{self.path}/commits/{name}.json")
        try:
            self._context.rename(draft, target, none)
        except Exception as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        return True

    def _records(self) -> dict[str, dict]:
        found = {}
        for status in self._files.listStatus(self._path(f"{self.path}/commits")):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = self._files.open(status.getPath())
                found[name[:-5]] = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
                stream.close()
        return found

    def committed(self) -> set[str]:
        """Ids of the batches that count."""
        records = self._records()
        return {k[6:] for k in records if k.startswith("batch-")} | {b for r in records.values() for b in r.get("folded", ())}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of signed rows once. False if the batch had been committed."""
        if batch in self.committed():
            return False
        folder = f"{self.path}/deltas/{batch}-{uuid.uuid4().hex}"
        sums = [F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_tokens", "n_chars")]
        changes.groupBy(*KEYS).agg(*sums).write.parquet(folder)
        return self._publish(f"batch-{batch}", {"folder": folder})

    def _live(self) -> tuple[list[str], list[str], int]:
        """Folders to sum, batches in them, and the number of the newest base."""
        records = self._records()
        bases = sorted(int(k[5:]) for k in records if k.startswith("base-"))
        newest = bases[-1] if bases else 0
        base = records.get(f"base-{newest}", {"folded": []})  # number 0 is no base
        fresh = [k for k in sorted(records) if k.startswith("batch-") and k[6:] not in set(base["folded"])]
        folders = [r["folder"] for r in (base, *(records[k] for k in fresh)) if "folder" in r]
        return folders, [*base["folded"], *(k[6:] for k in fresh)], newest

    def totals(self) -> DataFrame:
        folders = self._live()[0]
        rows = self.spark.read.schema(_DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], _DELTA)
        sums = [F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_tokens", "n_chars")]
        return rows.groupBy(*KEYS).agg(*sums).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def compact(self) -> bool:
        """Fold all committed batches into a new base; readers see the old or the new one."""
        folders, batches, newest = self._live()
        if not folders:
            return False
        folder = f"{self.path}/bases/{uuid.uuid4().hex}"
        self.totals().write.parquet(folder)
        return self._publish(f"base-{newest + 1}", {"folder": folder, "folded": batches})
