"""SimHash near-dedup by a segment-popcount embedding and a grid range-join.

Fingerprints are majority votes over XXH64 (seed 42) of the 4-word shingles of the text. They link at up
to RADIUS differing bits. The embedding counts the ones in each 2-bit segment; the Manhattan distance of
two count vectors is at most the number of differing bits. Written in unary, a count vector is a 64-bit
word again and the Manhattan distance is the number of bits in which two such words differ.

The 32 counts are cut into six blocks. Two vectors within Manhattan distance 4 agree in at least two
blocks, so the grid's cells are the pairs of blocks with their counts: 15 cells a fingerprint, and every
pair in range meets in one. In a cell, pairs are bounded by Manhattan distance, then verified exactly. A cell gives a
spanning forest of its links, not its pairs. A cell of over CELL distinct fingerprints gets a finer grid: the segments
in which its members may still differ are cut into six blocks, of which any pair in range agrees in two again. What
is crowded at the finest grid, LEVELS deep, is cut into chunks, and each pair of chunks is a task of its own.
Components are found over distinct fingerprints by alternating large and small stars in distributed rounds, until
a round changes nothing.

Defined cases: null and wordless texts have fingerprint zero and link like any other; a null id gives a
null component only if its whole component has no id; repeated rows stay; very long texts are hashed whole, the
votes summed in steps; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import bounded_batches, saved, spread_join, text_bytes, work_path
from .numeric import connected

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Distinct fingerprints a grid cell may hold before it gets a finer grid, and how many grids there are.
CELL, LEVELS = 4096, 3
_SEGMENTS = 32
_CUTS = (0, 5, 10, 15, 20, 26, 32)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - SHINGLE + 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    step = 1 << 16
    for at in range(0, len(hashes), step):
        part = np.array(hashes[at : at + step], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        raw = data.tobytes()
        fps = np.array([fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def text_sha256(text_col: str = "text") -> Column:
    """Digest of a text as it is; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text_sha256 of the one text that stays of each component: smallest id, null last, then smallest digest."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_sha256(text_col).alias("text_sha256"))
    fps = saved(base.mapInArrow(_fingerprints, "doc_id long, fp long, text_sha256 string"), "simhash")
    nodes = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")).alias("first"))
    roots = components(near_links(fps.select("fp").distinct()))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_sha256")


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unary_counts(fp: Column) -> Column:
    """Ones in each 2-bit segment, in unary: 00, 01, 11."""
    odd = F.lit(0x5555555555555555)
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(odd), fp.bitwiseAND(odd)
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def _unary(fp: np.ndarray) -> np.ndarray:
    odd = np.uint64(0x5555555555555555)
    high, low = (fp >> np.uint64(1)) & odd, fp & odd
    return high | low | ((high & low) << np.uint64(1))


def _mask(segments: list[int]) -> int:
    return sum(3 << (2 * s) for s in segments)


def finer(fixed: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The 15 cells of a cell: its fixed segments and two of six blocks of the others."""
    free = [s for s in range(_SEGMENTS) if s not in fixed]
    cuts = _CUTS if not fixed else [round(i * len(free) / 6) for i in range(7)]
    blocks = [free[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [tuple(sorted((*fixed, *blocks[i], *blocks[j]))) for i in range(6) for j in range(i)]


def grid_cells(fps: DataFrame) -> DataFrame:
    """(cell, key, fp): the 15 cells of every fingerprint."""
    cells = [F.struct(F.lit(c).alias("cell"), F.col("counts").bitwiseAND(F.lit(_long(_mask(fixed)))).alias("key")) for c, fixed in enumerate(finer(()))]
    return fps.select("fp", unary_counts(F.col("fp")).alias("counts")).select("fp", F.explode(F.array(*cells)).alias("c")).select("c.cell", "c.key", "fp")


def finer_cells(rows: DataFrame, grid: list[tuple[int, ...]]) -> DataFrame:
    """(cell, key, fp) of the next grid; grid: the fixed segments of the cells the rows are in."""
    masks = [[_long(_mask(fixed)) for fixed in finer(cell)] for cell in grid]
    table = rows.sparkSession.createDataFrame(list(enumerate(masks)), "cell int, masks array<long>")  # at most 225 rows
    each = rows.join(F.broadcast(table), "cell").select("cell", "fp", unary_counts(F.col("fp")).alias("counts"), F.posexplode("masks").alias("i", "mask"))
    return each.select((F.col("cell") * 15 + F.col("i")).alias("cell"), F.col("counts").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links_in_cells(cell: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Forest of links between rows of equal `cell` (sorted). side: 0 compares with all, 1 and 2 only with the other."""
    n = len(fp)
    counts = _unary(fp)
    left, right = [], []
    ends = np.concatenate([np.flatnonzero(cell[1:] != cell[:-1]) + 1, [n]]) if n else np.zeros(0, np.int64)
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    rows = np.arange(n)
    shift = 1
    while True:
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            break
        near = np.bitwise_count(counts[rows] ^ counts[rows + shift]) <= radius  # the Manhattan bound
        a = rows[near]
        a = a[np.bitwise_count(fp[a] ^ fp[a + shift]) <= radius]
        a = a[(side[a] == 0) | (side[a] != side[a + shift])]
        left.append(a)
        right.append(a + shift)
        shift += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    if not len(a):
        return a, b
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = connected(len(nodes), place[: len(a)], place[len(a) :])
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _join_cells(batches):
    """Links of whole groups (cell, key, task), from batches in group order; the last group waits."""
    names = ["cell", "key", "task", "side", "fp"]
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table):
        key, task, fp = (rows.column(c).to_numpy() for c in ("key", "task", "fp"))
        cell, side = rows.column("cell").to_numpy(), rows.column("side").to_numpy()
        new = np.concatenate([[False], (key[1:] != key[:-1]) | (task[1:] != task[:-1]) | (cell[1:] != cell[:-1])])
        a, b = links_in_cells(np.cumsum(new), fp.view(np.uint64), side)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["u", "v"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        last = [batch.column(names.index(c)).to_numpy() for c in ("cell", "key", "task")]
        same = np.logical_and.reduce([x == x[-1] for x in last])
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if held and (cut or any(held[-1].column(names.index(c))[0].as_py() != x[0] for c, x in zip(("cell", "key", "task"), last, strict=True))):
            yield from out(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield from out(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield from out(pa.Table.from_batches(held))


def near_links(fps: DataFrame, *, cell_size: int = CELL, levels: int = LEVELS) -> DataFrame:
    """Links (u, v) that connect all fingerprints within RADIUS as the full set of links would."""
    cells, grid, ready = grid_cells(fps), finer(()), None
    names = ["cell", "key", "task", "side", "fp"]
    for level in range(levels):
        crowded = saved(cells.groupBy("cell", "key").count().where(F.col("count") > cell_size), "simhash-crowded")
        full = crowded.limit(1).count()
        fit = (cells.join(crowded, ["cell", "key"], "left_anti") if full else cells).withColumns({"cell": F.col("cell") + (level << 16), "task": F.lit(0), "side": F.lit(0)}).select(names)
        ready = fit if ready is None else ready.unionByName(fit)
        if not full:
            break
        inside = cells.join(crowded.drop("count"), ["cell", "key"], "left_semi")
        if level + 1 < levels:
            cells, grid = saved(finer_cells(inside, grid), "simhash-finer"), [f for cell in grid for f in finer(cell)]
            continue
        # chunk pairs of what is crowded still: a member of chunk i goes to tasks (i, j) for every chunk j
        chunks = crowded.select("cell", "key", F.ceil(F.col("count") / cell_size).cast("int").alias("chunks"))
        mine = cells.join(chunks, ["cell", "key"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        mine = mine.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        low, high = F.least("i", "j"), F.greatest("i", "j")
        side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
        ready = ready.unionByName(mine.select((F.col("cell") + (level << 16)).alias("cell"), "key", (high * (high + 1) / 2 + low + 1).cast("int").alias("task"), side.alias("side"), "fp"))
    dealt = ready.select(names).repartition("cell", "key", "task").sortWithinPartitions("cell", "key", "task")
    return dealt.mapInArrow(_join_cells, "u long, v long").distinct()


def _star(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written out, and their number and a sum of hashes, taken while they are written."""
    seen = Observation()
    path = work_path(edges.sparkSession, "stars")
    edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), (seen.get["n"], seen.get["h"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes with links: alternating large and small stars, each round written out, until one changes nothing."""
    edges, mark = _star(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, (edges, mark) = mark, _star(small)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    fps = saved(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    rooted = saved(rooted.join(least, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-nodes")
    return fps.join(rooted, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
