"""Chat formatting by columnar byte assembly.

Turns are dealt by conversation and sorted by turn; each Arrow batch is then formatted without a loop
over rows: the lengths of all segments (header, escaped text, end mark) give cumulative offsets, the
offsets give scatter indices, and headers and contents are copied into one preallocated buffer, which
becomes the Arrow column. Loss spans (code points of the formatted text) come from the same offsets.

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside texts and roles get a backslash after their first character, and ones that look
escaped get one more, so escaping is reversible. Roles lose line feeds by the same device (`\\n` as text).

Defined cases: null text or role is empty; turns sort by (turn, role, text), null turn first; repeated
rows stay; every row without a conv_id is a conversation of its own, with one turn, so that such rows never meet in one
task; conv_id may be of any type; an empty table gives no rows; other columns, whatever their names, are not read. A
conversation is one value of one row, so it must fit in a worker; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, spans_to_index, text_bytes

#: Control strings of this template and of common ones.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

FORMATTED = "formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>"
READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _escape_roles(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(roles)


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns formatted on end, the byte offsets of the turns, and of each text's span."""
    role, role_at = text_bytes(_escape_roles(roles.fill_null("")))
    text, text_at = text_bytes(escape(texts.fill_null("")))
    opening, closing = np.frombuffer(OPEN.encode(), np.uint8), np.frombuffer(CLOSE.encode(), np.uint8)
    n, n_role, n_text = len(roles), np.diff(role_at), np.diff(text_at)
    sizes = len(opening) + n_role + 1 + n_text + len(closing)
    at = np.concatenate([[0], np.cumsum(sizes)])
    buffer = np.empty(at[-1], np.uint8)
    head = at[:-1]
    for mark, place in ((opening, head), (closing, at[1:] - len(closing))):
        buffer[(place[:, None] + np.arange(len(mark))).ravel()] = np.tile(mark, n)
    buffer[spans_to_index(head + len(opening), n_role)] = role
    start = head + len(opening) + n_role + 1
    buffer[start - 1] = 0x0A
    buffer[spans_to_index(start, n_text)] = text
    return buffer, at, start, start + n_text


def _format(batches):
    """Conversations of sorted turns; the last one of each batch waits for more of its turns."""
    held: list[pa.RecordBatch] = []

    def out(turns: pa.Table) -> pa.RecordBatch:
        turns = turns.combine_chunks()
        roles, texts = (turns.column(c).combine_chunks() for c in ("role", "text"))
        conv = turns.column("conv_id").to_pylist()
        buffer, at, start, end = assemble(roles, texts)
        first = [i for i in range(len(conv)) if i == 0 or conv[i] is None or conv[i] != conv[i - 1]]
        bounds = np.array([*first, len(conv)])
        points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])  # code points before each byte
        loss = pc.equal(roles.fill_null(""), "assistant").to_numpy(zero_copy_only=False)
        base = np.repeat(points[at[bounds[:-1]]], np.diff(bounds))
        kept = np.concatenate([[0], np.cumsum(loss)])[bounds]
        column = pa.StringArray.from_buffers(len(first), pa.py_buffer(at[bounds].astype(np.int32)), pa.py_buffer(buffer))
        lists = [pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array((points[x] - base)[loss], pa.int64())) for x in (start, end)]
        return pa.RecordBatch.from_arrays([turns.column("conv_id").combine_chunks().take(pa.array(first, pa.int64())), column, pa.array(np.diff(bounds), pa.int64()), *lists], ["conv_id", "formatted", "n_turns", "loss_starts", "loss_ends"])

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_pylist()
        cut = len(conv)
        while cut and conv[-1] is not None and conv[cut - 1] == conv[-1]:
            cut -= 1
        if held and (cut or held[-1].column(0)[0].as_py() != conv[0]):
            yield out(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield out(pa.Table.from_batches([batch.slice(0, cut)]))
        if cut < len(conv):
            held.append(batch.slice(cut))
    if held:
        yield out(pa.Table.from_batches(held))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a conversation: formatted text, number of turns, and the loss spans (assistant texts)."""
    bounded_batches(turns.sparkSession)
    turns = turns.select("conv_id", F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(0)
    dealt = turns.withColumn("_lone", lone).repartition("conv_id", "_lone").drop("_lone").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format, _with_id(turns, FORMATTED))


def _with_id(df: DataFrame, schema: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *T.StructType.fromDDL(schema).fields])


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _digest(batches):
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends")), strict=True):
            turns = parse(text)
            whole = hashlib.sha256()
            for role, content in turns:
                whole.update(f"{role}\n{content}\n".encode())
            loss, size = hashlib.sha256(), 0
            for a, b in zip(starts, ends, strict=True):
                content = unescape(text[a:b])
                loss.update(content.encode())
                size += len(content)
            rows.append((len(turns), whole.hexdigest(), size, loss.hexdigest(), len(text)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", *names])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader gets back from the formatted text and the loss mask."""
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(_digest, _with_id(formatted, READ_BACK))
