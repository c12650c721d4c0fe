"""The corpus operators against brute force, with nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns of clashing names."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import chat, common, decontam, exact_dedup, langid, mixing, numeric, quality, queries, simhash, suffix_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", bucket string, fp string, score string, _row string, h string, kept string"

rng = random.Random(5)
VOCABULARY = {
    "en": ["the", "house", "that", "with", "thing", "weather", "other", "which", "these", "through", "would", "their", "light", "might", "night"],
    "de": ["der", "haus", "nicht", "einer", "schnell", "werden", "zwischen", "über", "straße", "möglich", "durch", "welche", "tür", "gehen", "ich"],
}


def prose(lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


LONG = prose("en", 40_000)
PASSAGE = prose("en", 60)
BASE = [prose("de" if i % 3 == 0 else "en", 30 + i) for i in range(40)]
TEXTS = [
    *BASE,
    None, "", "", " \n\t", "12 34 !!", LONG, LONG, LONG[:-9],
    *(BASE[1] + " " * i for i in range(4)),  # copies up to white space, the longest stays
    *(f"{BASE[2]} {w}" for w in ("one", "two", "three")),  # near copies
    *(f"{prose('en', 5)} {PASSAGE} {prose('de', 5)}" for _ in range(6)),  # a shared passage
    "ab" * 300, "ab" * 300, "x" * 101, "x" * 99, "é" * 80, "🙂 smile 🙂 " * 30, "A\x0bB\x0cC",
]


def rows():
    out = [(i, t, "de" if i < 40 and i % 3 == 0 else "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    out[7] = (7, TEXTS[7], None, "s1", None)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def wide(docs):
    """The same with columns named like inner ones."""
    return docs.selectExpr("*", "'x' as bucket", "'x' as fp", "'x' as score", "'x' as _row", "'x' as h", "'x' as kept", "'x' as lang_pred", "'x' as mix_rate", "'x' as _lang", "'x' as _leaks")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# exact dedup


def brute_exact(data):
    groups = {}
    for i, t in data:
        groups.setdefault(exact_dedup.normalised(t), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm).hexdigest())
    return out


@pytest.mark.parametrize("resolve_at", [exact_dedup.RESOLVE_AT, 1])
def test_exact_dedup(spark, wide, resolve_at, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RESOLVE_AT", resolve_at)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(wide, bucket_bytes=200).collect()}
    assert got == brute_exact([(r[0], r[1]) for r in rows()])


def entry(key, size, packed, ids, points, task=0, seq=0):
    return (0, key, task, seq, size, packed, b"s", np.array(ids, "<i8").tobytes(), np.array(points, "<i4").tobytes())


def entries(*cells):
    return exact_dedup._batch(list(cells), exact_dedup._ENTRY_KINDS, exact_dedup._ENTRY)


def test_exact_chain_of_many_members(monkeypatch):
    """Classes that are resolved by a join give the same as those that are not."""
    monkeypatch.setattr(exact_dedup, "RESOLVE_AT", 10)
    ids = list(range(50))
    out = [r for b in exact_dedup._own([entries(entry(1, 3, b"zzz", ids, [7] * 50)), entries(entry(1, 3, None, ids, [7] * 50))]) for r in b.to_pylist()]
    assert [r for r in out if r["kind"] == "class"][0]["group_size"] == 100
    assert sum(r["kind"] == "member" and r["kept"] for r in out) == 1


def test_exact_collisions():
    """Texts of one key are told apart by their bytes."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    batch = entries(*(entry(1, 3, z.compress(t), [i], [3], seq=i) for i, t in enumerate((b"aaa", b"bbb", b"aaa"))))
    got = {r["doc_id"]: r["keep_id"] for b in exact_dedup._own([batch]) for r in b.to_pylist()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_exact_bytes_travel_once_a_task(monkeypatch):
    """A copied text is sent once while it is remembered; what was forgotten is sent again, with the same result."""
    texts = [str(random.Random(s).random()) * 20 for s in range(4)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(4 * k, 4 * k + 4)), pa.array(texts)], ["doc_id", "text"]) for k in range(3)]
    directory = np.zeros(1 << exact_dedup.BITS, np.int32)
    found = []
    for recent in (exact_dedup.RECENT_BYTES, 0):
        monkeypatch.setattr(exact_dedup, "RECENT_BYTES", recent)
        rows = sorted((tuple(r.values()) for b in exact_dedup._entries(directory)(batches) for r in b.to_pylist()), key=lambda r: (*r[:4], r[5] is None))
        assert sum(r[5] is not None for r in rows) == (4 if recent else 12)
        found.append(sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for b in exact_dedup._own([entries(*rows)]) for r in b.to_pylist()))
    assert found[0] == found[1] == sorted((i, i % 4, 3, i < 4) for i in range(12))


def test_exact_repeated_rows_and_null_ids(spark, empty, monkeypatch):
    most = (1 << 63) - 1
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "a b"), (None, "q"), (most, "q q"), (None, "qq"), (None, "r  r"), (most, "r r")], "doc_id long, text string")
    for resolve_at in (exact_dedup.RESOLVE_AT, 1):
        monkeypatch.setattr(exact_dedup, "RESOLVE_AT", resolve_at)
        got = exact_dedup.exact_dedup(df).collect()
        assert sum(r.kept for r in got) == 4 and len(got) == 9
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 4), (2, 1, 4), (None, 1, 4), (None, None, 1), (most, most, 2), (None, most, 2), (None, None, 2), (most, None, 2)}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles_where_buckets_overflow():
    sizes = lambda **by: np.array([by.get(f"p{i}", 0) for i in range(256)])
    directory = exact_dedup.build_directory(sizes(p0=100, p1=100, p200=5, p255=5), 120)
    assert directory[0] != directory[1] and directory[200] == directory[255] and len(directory) == 256
    assert len(set(exact_dedup.build_directory(sizes(p3=10**9), 10).tolist())) == 9  # one path of splits, then a chain
    assert set(exact_dedup.build_directory(sizes(), 10).tolist()) == {0}


# SimHash


def brute_components(fps):
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= simhash.RADIUS)
    return numeric.connected(len(fps), a, b)


@pytest.mark.parametrize("cell", [simhash.CELL, 1])
def test_simhash(spark, wide, cell, monkeypatch):
    links = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda fps: links(fps, cell_size=cell))
    got = by_id(simhash.simhash_components(wide))
    ids = [r[0] for r in rows()]
    fps = np.array([simhash.fingerprint((r[1] or "").encode()) for r in rows()], np.uint64)
    assert [got[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps.tolist()]
    assert [got[i].component_id for i in ids] == [ids[j] for j in brute_components(fps)]


def test_fingerprint_by_definition():
    import xxhash

    text = "One two THREE four\tfive  six é É"
    words = "one two three four five six é É".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"A  b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(b" \n") == 0


def test_embedding_is_a_lower_bound():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for _ in range(6):
        b ^= np.uint64(1) << r.integers(0, 64, 2000, dtype=np.uint64)
    assert (np.bitwise_count(simhash._unary(a) ^ simhash._unary(b)) <= np.bitwise_count(a ^ b)).all()


def test_dense_cluster_links(spark, empty):
    """Fingerprints that differ in few bits, many to a cell: chunked cells lose no link."""
    r = np.random.default_rng(2)
    fps = np.unique(np.array([0xABCDEF0123456789 ^ sum(1 << int(x) for x in r.choice(64, r.integers(0, 9), replace=False)) for _ in range(400)], np.uint64))
    df = spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp long")
    want = brute_components(fps)
    for cell, levels in ((16, 3), (16, 1), (10_000, 3)):
        roots = {x.node: x.root for x in simhash.components(simhash.near_links(df, cell_size=cell, levels=levels)).collect()}
        found = [roots.get(int(f.view(np.int64)), int(f.view(np.int64))) for f in fps]
        assert len(set(zip(found, want.tolist()))) == len(set(want.tolist())) == len(set(found))
    assert simhash.simhash_components(empty).count() == 0


def test_finer_grids_lose_no_pair():
    """Whatever four differences two count vectors have, they agree in a cell of every grid."""
    r = random.Random(6)
    for _ in range(300):
        grid = [()]
        apart = {r.randrange(32) for _ in range(4)}
        for _ in range(simhash.LEVELS):
            grid = [f for cell in grid for f in simhash.finer(cell) if not apart & set(f)]
            assert grid
    assert all(len(simhash.finer(c)) == 15 for c in simhash.finer(()))


def test_long_chain_is_one_component(spark):
    """A path of 700 links takes many rounds; stars go on until nothing changes."""
    links = spark.createDataFrame([(i, i + 1) for i in range(700)] + [(2000, 2001)], "u long, v long")
    assert {(x.node, x.root) for x in simhash.components(links).collect()} == {(i, 0) for i in range(1, 701)} | {(2001, 2000)}


# repeated substrings


def brute_repeats(data, depth=100):
    seen, out = set(), {}
    for i, text in sorted(data):
        b = (text or "").encode()
        cover = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                cover[p] += 1
                cover[p + depth] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_substrings(wide):
    short = wide.where("doc_id not in (45, 46, 47)")  # the very long texts have a test of their own
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(short).collect()}
    assert got == brute_repeats([(r[0], r[1]) for r in rows() if r[0] not in (45, 46, 47)])


def test_repeats_with_frequent_minimizers(wide, monkeypatch):
    """Runs cut into windows give the same as runs sorted whole."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 3)
    monkeypatch.setattr(suffix_dedup, "IN_A_TASK", 2)
    short = wide.where("doc_id not in (45, 46, 47)").coalesce(1)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(short).collect()}
    assert got == brute_repeats([(r[0], r[1]) for r in rows() if r[0] not in (45, 46, 47)])


@pytest.mark.parametrize(("depth", "gram"), [(20, 8), (33, 32), (24, 24)])
def test_repeats_of_random_strings(spark, depth, gram):
    r = random.Random(depth)
    data = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 90))) * r.randint(1, 3)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.remove_repeats(df, depth=depth, gram=gram).collect()}
    assert got == brute_repeats(data, depth)


def test_repeats_in_long_texts(spark):
    data = [(2, LONG), (1, LONG[:-9]), (3, LONG)]
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), with_text=True))
    assert got[3].n_removed == len(LONG) and got[3].n_spans == 1 and got[3].kept_text == b""
    assert got[2].n_bytes == len(LONG) and got[2].n_removed >= len(LONG) - 9


def test_repeats_with_odd_ids(spark, empty):
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([(1, t), (1, t), (1, t + "!"), (None, t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    one = len(t)
    assert [g[:2] for g in got] == [(False, one), (False, one), (False, one + 1), (True, 0), (True, one)]
    assert sum(g[2] for g in got if not g[0]) in (one, 2 * one)  # whichever of the two texts of id 1 comes first
    assert got[-1][2] == one
    most = (1 << 63) - 1
    df = spark.createDataFrame([(None, t), (most, t), (most, "?" + t[:-1])], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_repeats(df.where("length(text) > 0 and substr(text, 1, 1) <> '?'")).collect()}
    assert got == {(None, one): one, (most, one): 0}
    assert {r.doc_id for r in suffix_dedup.remove_repeats(df).collect()} == {None, most}
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_equal_runs():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    size = r.integers(8, 40, 900)
    at = r.integers(0, 3900, 900)
    raw = data.tobytes()
    got = suffix_dedup.equal_runs(data, at, size, suffix_dedup.grouped(size))
    first = {}
    assert got.tolist() == [first.setdefault(raw[a : a + n], i) for i, (a, n) in enumerate(zip(at.tolist(), size.tolist()))]
    assert len(first) < 900
    assert suffix_dedup.equal_runs(data, at[:0], size[:0], size[:0]).tolist() == []


def test_seldom_minimizers_of_many_tasks_are_estimated(monkeypatch):
    """One that every task has three times is found by its sampled sum."""
    text = "".join(random.Random(1).choices("abcdefgh ", k=400))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"]), pa.array([text])], ["pos", "sha", "text"])
    true = np.unique(suffix_dedup.runs_of(*common.text_bytes(batch.column(2)))[4])
    total = {}
    for task in range(3000):
        monkeypatch.setattr(suffix_dedup.TaskContext, "get", staticmethod(lambda t=task: type("T", (), {"partitionId": lambda self: t})()))
        for out in suffix_dedup._count_in_tasks(100, 32, 8, 16)([batch, batch, batch]):
            for h, n in zip(out.column(0).to_numpy().view(np.uint64).tolist(), out.column(1).to_pylist()):
                total[h] = total.get(h, 0) + n
    assert set(total) == set(true.tolist()) and all(0.6 * 9000 < n < 1.4 * 9000 for n in total.values())


def test_repeats_across_steps(wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEP", 64)
    runs = suffix_dedup.runs_of(*common.text_bytes(pa.array(TEXTS[:6] + ["", LONG[:2000]])))
    monkeypatch.setattr(suffix_dedup, "_STEP", 1 << 22)
    whole = suffix_dedup.runs_of(*common.text_bytes(pa.array(TEXTS[:6] + ["", LONG[:2000]])))
    windows = lambda x: sorted({(int(r), int(o), int(o) - h, int(g)) for r, o, a, b, g in zip(*x) for h in range(int(b), int(a) + 1)})
    assert windows(runs) == windows(whole)


# language ID


def brute_cost(samples, lang, text, order=langid.ORDER):
    """Escape codes of method C, one byte after the other."""
    fold = lambda t: langid.coded_bytes(pa.array([t]))[0].tolist()
    counts = {}
    for t in samples[lang]:
        data = fold(t)
        for i in range(order, len(data)):
            for o in range(order + 1):
                c = counts.setdefault(tuple(data[i - o : i]), {})
                c[data[i]] = c.get(data[i], 0) + 1
    total, data = 0.0, fold(text)
    for i in range(order, len(data)):
        for o in range(order, -1, -1):
            c = counts.get(tuple(data[i - o : i]))
            if c is None:
                continue
            n, u = sum(c.values()), len(c)
            if data[i] in c:
                total += np.log2((n + u) / c[data[i]])
                break
            total += np.log2((n + u) / u)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    samples = {"de": ["der die das straße", "nicht"], "en": ["the thing that", "THE weather!"]}
    trees = langid.ContextTrees.of_texts(samples)
    texts = ["the straße", "zebra 42", "", "ß", "die thing -- that"]
    bits, lengths = trees.bits(pa.array(texts))
    for i, t in enumerate(texts):
        for j, lang in enumerate(("de", "en")):
            assert bits[i, j] == pytest.approx(brute_cost(samples, lang, t), rel=1e-5, abs=1e-5)


def test_language_id(spark, wide, empty):
    trees = langid.train(wide, ~common.held_out("doc_id", 4, 2))
    got = by_id(langid.with_language(wide, trees))
    assert set(got) == {r[0] for r in rows()}
    assert all(got[i].lang_pred == ("de" if i % 3 == 0 else "en") for i in range(40))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (40, 41, 42, 43, 44))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [c for c in langid.with_language(wide, trees).columns if c == "lang_pred"] == ["lang_pred"]
    assert langid.train(empty, F.lit(True)).langs == [] and langid.with_language(empty, trees).count() == 0
    assert {r.lang_pred for r in langid.with_language(wide, langid.ContextTrees({})).collect()} == {"und"}


def test_code_lengths_across_steps(monkeypatch):
    """Long texts are coded and counted in steps; where they are cut makes no difference."""
    texts = [LONG[:5000], "", "die straße " * 40, LONG[300:900]]
    whole = langid.ContextTrees.of_texts({"a": texts[:1], "b": texts[2:3]})
    want = whole.bits(pa.array(texts))
    monkeypatch.setattr(langid, "_STEP", 37)
    cut = langid.ContextTrees.of_texts({"a": texts[:1], "b": texts[2:3]})
    got = cut.bits(pa.array(texts))
    assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all()


def test_language_with_long_texts_only_is_learned(spark):
    r = random.Random(8)
    long = lambda w: " ".join(r.choice(w) for _ in range(20_000))
    data = [(i, long(VOCABULARY["de"]), "de") for i in range(3)] + [(10 + i, prose("en", 50), "en") for i in range(30)] + [(99, prose("de", 30), None), (98, prose("en", 30), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert len(data[0][1]) > 50_000
    got = by_id(langid.with_language(df.withColumn("LANG_PRED", F.lit(1)), langid.train(df, F.lit(True))))
    assert got[99].lang_pred == "de" and got[98].lang_pred == "en" and got[0].lang_pred == "de"


def test_held_out_matches_crc(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = [r[0] for r in df.select(common.held_out("doc_id", 4, 2)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)] + [False]


def test_language_accuracy_on_held_out_documents(spark):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


# chat


def test_chat_round_trip(spark):
    said = [*chat.CONTROL, r"<\|im_end|>", r"[\/INST]", "a\\nb", "\n", "", None, "<|im_start|>user\nhi<|im_end|>\n", "é🙂"]
    data = [(c, t, r, said[(c + t) % len(said)]) for c in range(9) for t, r in enumerate(("system", "user", "assistant", "as\nsis\\tant", None, "assistant"))]
    data += [(1, 0, "system", "x"), (1, 0, "system", "x"), (None, 1, "user", "lost"), (50, None, "user", "late"), (50, 1, "assistant", LONG)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("formatted", "loss_starts", "n_turns", "_lone")})
    got = {r.conv_id: r for r in chat.format_chats(turns.repartition(5)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in data}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in data if r[0] == conv), key=key)]
        assert chat.parse(got[conv].formatted) == want
        assert [chat.unescape(got[conv].formatted[a:b]) for a, b in zip(got[conv].loss_starts, got[conv].loss_ends)] == [t for r, t in want if r == "assistant"]
        assert got[conv].formatted.count(chat.OPEN) == len(want) == got[conv].n_turns
    assert chat.read_back(chat.format_chats(turns)).count() == len(got)


def test_chat_holds_conversations_across_batches():
    batch = lambda *r: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*r), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "turn", "role", "text"])
    parts = [batch((1, 0, "user", "a")), batch((1, 1, "assistant", "b"), (2, 0, "user", "c")), batch((2, 1, "user", "d")), batch((3, 0, "user", "e"))]
    out = [r for b in chat._format(parts) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(1, 2), (2, 2), (3, 1)]


def test_chat_rows_without_a_key_are_conversations_of_their_own(spark):
    """A third of all rows without conv_id: 30,000 conversations of one turn, in several tasks; ids of text go too."""
    turns = spark.range(90_000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.floor(F.col("id") / 30))).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small partitions stay apart
    try:
        got = spark.createDataFrame(chat.read_back(chat.format_chats(turns)).withColumn("task", F.spark_partition_id()).toArrow())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lone = got.where("conv_id is null").agg(F.count("*"), F.max("n_turns"), F.count_distinct("loss_sha256"), F.count_distinct("task")).first()
    assert tuple(lone)[:3] == (30_000, 1, 30_000) and lone[3] > 1
    assert got.where("conv_id is not null").agg(F.count("*"), F.min("n_turns")).first() == (3000, 20)


def test_chat_empty(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# decontamination


def test_decontamination_equals_brute_force(spark, empty):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 20
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, f"{text(r.randint(4, 40))}. {text(r.randint(2, 9))}.") for i in range(60)] + [(60, None), (61, ""), (62, "solo"), (None, "x")]
    data = []
    for i in range(150):
        parts = [text(r.randint(0, 400))]
        for _ in range(r.randint(0, 2)):
            w = r.choice(items[:60])[1].upper().split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "other"
            parts += [" ".join(w), text(r.randint(0, 90))]
        data.append((i, " ".join(parts)))
    data += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (903, "SOLO!")]
    want = leaks_by_hand(items, data)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("LEAKS", F.lit("x"))
    for block_items in (decontam.BLOCK_ITEMS, 12):
        index = decontam.build_index(benchmark, block_items=block_items)
        assert (len(index) > 1) == (block_items < 60)
        got = {(x.doc_id, x.item_id) for x in decontam.leaked_pairs(df, index).collect()}
        assert got == want and len(want) > 60 and (903, 62) in want
    assert decontam.with_leaks(df, index).columns == ["doc_id", "text", "leaks"]
    assert decontam.leaked_pairs(empty, index).count() == 0
    assert decontam.leaked_pairs(df, decontam.build_index(benchmark.limit(0))).count() == 0


def leaks_by_hand(items, data):
    """Pairs of which some passage, of any place the operator may cut, has the overlaps."""
    want = set()
    for item_id, text in items:
        if not (parts := decontam.parted(text or ""))[0]:
            continue
        words, question, answer = parts
        longest = decontam.SHORT
        while longest < len(words):
            longest *= 2
        stride, n = longest // 2, min(5, len(words))
        shingles = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        for i, t in data:
            w = decontam.words_of(t)
            for s in (s for s in range(0, len(w), stride) if s == 0 or s + 2 * stride < len(w)):
                p = w[s : s + 3 * stride]
                have = set(p)
                whole = len(shingles & {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}) / len(shingles)
                if whole >= 0.8 and all(len(set(x) & have) >= 0.8 * len(set(x)) for x in (question, answer)):
                    want.add((i, item_id))
    return want


def test_very_long_items_do_not_widen_the_others_passages():
    """Items of 8,000 and 2,000 words beside short ones: found, and in the time that short ones take."""
    import time

    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    items = [(i, f"{text(20)}. {text(5)}.") for i in range(2000)] + [(5000, text(8000)), (5001, text(2000))]
    index = decontam.Index(items)
    docs = [text(5000) for _ in range(20)] + [f"{text(900)} {items[2000][1]} {text(700)}", f"{items[2001][1]} {items[3][1]}", items[7][1]]
    began = time.perf_counter()
    got = decontam.find_leaks(index, pa.array(docs))
    assert time.perf_counter() - began < 30
    assert [[x["item_id"] for x in leaks] for leaks in got] == [[]] * 20 + [[5000], [3, 5001], [7]]


def test_retrieval_equals_exhaustive_scoring():
    r = random.Random(4)
    items = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(r.randint(3, 20)))) for i in range(70)]
    for threshold in (0.3, 0.7):
        index = decontam.Index(items, block=4, threshold=threshold)
        postings = index.classes[0]
        terms = np.array([r.randrange(len(index.vocabulary)) for _ in range(400)])
        segment = np.sort(np.array([r.randrange(40) for _ in range(400)]))
        p, j, s = postings.retrieve(terms, segment, np.array([25, 15]))
        want = {}
        for a in [*range(23), *range(25, 38)]:
            mine = sorted(set(terms[(segment >= a) & (segment < a + 3)].tolist()))
            scores = np.zeros(len(postings.items))
            for t in mine:
                np.add.at(scores, postings.item[postings.at[t] : postings.at[t + 1]], postings.weight[postings.at[t] : postings.at[t + 1]])
            hits = {(a, int(k)): scores[k] for k in np.flatnonzero(scores >= threshold - 1e-9)}
            want |= hits
            assert [x for x, _ in postings.walk(mine)] == [k for _, k in hits]
        assert dict(zip(zip(p.tolist(), j.tolist()), s.tolist())) == pytest.approx(want) and want


# toxicity


@pytest.fixture(scope="module")
def toxic_model(spark):
    sf = "/root/testdata/sf0.1"
    return toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), ~common.held_out("doc_id", 5, 0))


@pytest.mark.parametrize(
    ("written", "meant"),
    [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("m0r0n", "moron"), ("p@thetic", "pathetic"), ("w0rthl3ss", "worthless"), ("st*pid", "stupid"), ("5tupid", "stupid"), ("$tupid", "stupid"), ("s-c-u-m", "scum"), ("looooser", "loser"), ("house", "house"), ("house,", "house")],
)
def test_deobfuscation(toxic_model, written, meant):
    assert toxicity.Words(toxic_model.bits, []).of_tokens([written]) == [meant]


def test_viterbi_is_exhaustive_search(toxic_model):
    import itertools

    bits, n = toxic_model.bits, toxicity.CLASSES
    restorer = toxicity.Restorer(bits)
    for token in ("1d10t", "l0s3r!", "a--b11", "ooo0o", "€1|"):
        best = None
        for path in itertools.product(*(restorer.options(token, i) for i in range(len(token)))):
            text = "".join(x for x, _ in path)
            classes = [0, 0, 0, *map(toxicity._class_of, text), 0]
            cost = sum(c for _, c in path) + sum(bits[((a * n + b) * n + c) * n + d] for a, b, c, d in zip(classes, classes[1:], classes[2:], classes[3:]))
            best = min(best or (cost, text), (cost, text))
        assert restorer.restore(token) == best[1]


def test_long_tokens_take_linear_time(toxic_model, monkeypatch):
    """Parts of a path that all live paths share are settled early; the reading stays the same."""
    import time

    r = random.Random(2)
    blob = "".join(r.choice("abcdefgh0123456789+/=.ooo") for _ in range(3000))
    want = toxicity.Restorer(toxic_model.bits).restore(blob)
    monkeypatch.setattr(toxicity, "_SETTLE", 8)
    restorer = toxicity.Restorer(toxic_model.bits)
    assert restorer.restore(blob) == want and restorer.seen == {}
    monkeypatch.setattr(toxicity, "_SETTLE", 512)
    began = time.perf_counter()
    restorer.restore(blob * 20)
    short = time.perf_counter() - began
    began = time.perf_counter()
    restorer.restore(blob * 80)
    assert time.perf_counter() - began < 10 * short + 1


def test_words_that_spaces_cut(toxic_model):
    words = toxicity.Words(toxic_model.bits, ["idiot", "moron", "idio*", "the", "stupid"])
    names = lambda text: {["idiot", "moron", "idio*", "the", "stupid"][i] for i in words.features(pa.array([text]))[1]}
    for text in ("an idi ot here", "id io t", "so 1d i0 t!", "ID 10 T"):
        assert {"idiot", "idio*"} <= names(text)
    assert names("mor on, stu pid") == {"moron", "stupid"}
    assert names("the id of it is on") == {"the"} and names("idi the ot") == {"the"} and names("") == set()
    assert toxicity.core_of("$#!+") == "$#!+" and toxicity.core_of("!!!!") == "" and toxicity.disguised("1010") and not toxicity.disguised("20%")


def test_gram_counts_by_hand():
    texts = ["Ab  c-d", "", None, "é1x", "zz"]
    code = [0, 0, 0]
    for text in texts:
        for c in " " + (text or "").lower():
            k = ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0
            if k or code[-1] or len(code) == 3:
                code.append(k)
    code.append(0)
    want = np.zeros(toxicity.CLASSES**4, int)
    for gram in zip(code, code[1:], code[2:], code[3:]):
        want[np.dot(gram, toxicity.CLASSES ** np.arange(3, -1, -1))] += 1
    assert (toxicity.gram_counts(pa.array(texts)) == want).all()


def test_toxicity_scores_by_hand(toxic_model):
    """Whole scores of texts of long words: tokens, restored words, beginnings, counts, densities, the logistic sum."""
    r = random.Random(11)
    some = [w for w in toxic_model.vocabulary if w.isalpha() and len(w) > 4][:30]
    texts = [" ".join(r.choice([*some, "weather", "1d10t", "w0rthl3ss", "Thing,", "\"light\""]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts += [" ".join(r.choices(["weather", "Thing,", "\"light\"", "house"], k=12)) for _ in range(20)]
    place, restorer = {w: i for i, w in enumerate(toxic_model.vocabulary)}, toxicity.Restorer(toxic_model.bits)
    want = []
    for text in texts:
        counts, tokens = {}, text.lower().split()
        for token in tokens:
            core = toxicity.core_of(token)
            word = restorer.restore(core) if toxicity.disguised(core) else core
            for name in [word, *(word[:k] + "*" for k in (4, 5, 6, 7) if len(word) > k)]:
                if name in place:
                    counts[name] = counts.get(name, 0) + 1
        z = toxic_model.bias + sum(toxic_model.weights[place[w]] * np.log1p(c) + toxic_model.weights[place[w] + len(place)] * min(20 * c / len(tokens), 2) for w, c in counts.items())
        want.append(1 / (1 + np.exp(-z)))
    got = toxic_model.scores(pa.array(texts), toxicity.Words(toxic_model.bits, toxic_model.vocabulary))
    assert got.tolist() == pytest.approx(want, rel=1e-6, abs=1e-9) and min(want) < 0.5 < max(want)


def test_logistic_fit_equals_newton():
    r = np.random.default_rng(5)
    x = r.poisson(0.6, (500, 6)).astype(float)
    y = (r.random(500) < 1 / (1 + np.exp(1 - x @ np.array([2.0, -1.0, 0.5, 0.0, 1.0, -2.0])))).astype(float)
    row, index = np.nonzero(x)
    w, b = toxicity.fit_logistic(y, row, index, x[row, index], 6)
    wide, best = np.column_stack([x, np.ones(500)]), np.zeros(7)
    ridge = np.diag([0.01] * 6 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-wide @ best))
        best -= np.linalg.solve((wide * (p * (1 - p))[:, None]).T @ wide + ridge, wide.T @ (p - y) + ridge @ best)
    assert np.allclose([*w, b], best, atol=0.05)


def test_restored_words_score(toxic_model):
    words = toxicity.Words(toxic_model.bits, toxic_model.vocabulary)
    clean = "The and attion to thanedble the, anea. Eriner thanea it"
    plain, spaced, leet, none = toxic_model.scores(pa.array([f"{clean} idiot moron", f"{clean} i d i o t M 0 R 0 N", f"{clean} 1d1ot m-o-r-o-n", clean]), words)
    assert plain > 0.5 and spaced > 0.5 and leet > 0.5 and none < 0.1


def test_toxicity_accuracy_on_held_out_documents(spark, toxic_model):
    sf = "/root/testdata/sf0.1"
    got = toxicity.with_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), toxic_model).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(common.held_out("doc_id", 5, 0))
    hit = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert hit[0] > 0.97 and hit[1] > 0.85 and hit[2] < 0.01


def test_toxicity_of_odd_rows(spark, wide, empty, toxic_model):
    got = by_id(toxicity.with_toxicity(wide, toxic_model))
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got.values())
    assert got[40].score == got[41].score
    assert toxicity.with_toxicity(empty, toxic_model).count() == 0
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    base = toxicity.train(wide, labels, F.lit(True))
    assert base.vocabulary == [] and toxicity.with_toxicity(wide, base).count() == len(TEXTS)
    assert toxicity.train(empty, labels.limit(0), F.lit(True)).bias < 0


# quality


def test_quality_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op2_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.97


def quality_by_hand(text):
    raw = (text or "").encode()
    out = dict.fromkeys(quality.NAMES, 0.0)
    if not raw:
        return out
    import zstandard

    share = lambda chars: sum(b in chars.encode() for b in raw) / len(raw)
    for name, chars in (("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("symbol", "*%&#$@~^_+=<>{}\\"), ("bang", "!"), ("bar", "|"), ("stop", ".?"), ("comma", ",;"), ("line", "\n"), ("colon", ":/")):
        out[name] = share(chars)
    out["wide"] = sum(128 <= b < 192 for b in raw) / len(raw)
    out["log_bytes"], out["packed"] = np.log1p(len(raw)), len(zstandard.ZstdCompressor(level=1).compress(raw)) / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    if words:
        n = len(words)
        out |= {"mean_word": sum(map(len, words)) / n, "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / len(lines), "long_words": sum(len(w) > 15 for w in words) / n}
        out |= {"one_letter": sum(len(w) == 1 for w in words) / n, "top_word": max(words.count(w) for w in set(words)) / n, "top_line_share": max(map(len, lines)) / len(raw)}
    return out


def test_quality_features_by_hand():
    texts = [*TEXTS[:45], *TEXTS[48:], "A|b: c/d, e; f?\nA|b\n\nzz", "\n", "x" * 40]
    got = quality.features(pa.array([t or "" for t in texts]))
    for row, text in zip(got, texts):
        assert row.tolist() == pytest.approx([quality_by_hand(text)[n] for n in quality.NAMES])


def test_quality_scores_are_sums_of_tables():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction and nothing else
    model = quality.AdditiveModel(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    one = x[:1]
    z = model.bias + sum(t[np.searchsorted(e, one[0, k], "right")] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
    z += sum(t[np.searchsorted(model.coarse[i], one[0, i], "right"), np.searchsorted(model.coarse[j], one[0, j], "right")] for i, j, t in model.pairs)
    assert model.scores(one)[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_of_odd_rows(spark, wide, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(wide, labels, F.lit(True))
    got = by_id(quality.with_quality(wide, model))
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got.values())
    assert quality.with_quality(empty, model).count() == 0
    none = quality.train(empty, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.with_quality(wide, none).collect()} == {0.5}
    x = quality.features(pa.array(["", None, LONG, "\n\n"]).fill_null(""))
    assert np.isfinite(x).all() and (x[0] == 0).all()


# token counts


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    store = token_counts.Rollup(spark, str(tmp_path / "r"))
    rows = lambda *r: spark.createDataFrame(list(r), "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
    totals = lambda: sorted(map(tuple, store.totals().collect()), key=repr)
    assert totals() == [] and not store.compact()
    assert store.apply("1", rows(("a", "en", "v1", 1, 10, 50), ("a", "en", "v1", 1, 5, 20), (None, None, "v1", 1, 1, 1)))
    assert not store.apply("1", rows(("a", "en", "v1", 1, 10, 50)))
    assert not token_counts.Rollup(spark, str(tmp_path / "r"))._publish("batch-1", {"folder": "nowhere"})
    assert store.compact()
    assert store.apply("2", rows(("a", "en", "v1", -1, -10, -50), (None, None, "v1", -1, -1, -1)))
    assert not store.apply("1", rows(("a", "en", "v1", 1, 10, 50)))
    want = [("a", "en", "v1", 1, 5, 20)]
    assert totals() == want and store.compact() and totals() == want and store.committed() == {"1", "2"}


def test_token_counts_query_equals_brute_force(spark):
    import re

    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    encoders = {v: token_counts.encoding(v, token_counts.read_vocabulary(f"{queries.TOKENIZERS}/{v}.tiktoken")) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    assert isinstance(encoders["byte_bpe_50k"], tiktoken.Encoding)
    want, seen = {}, set()
    for d in sorted(docs, key=lambda d: d.doc_id):
        text = d.text or ""
        flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
        for v, t, keep in (("byte_bpe_multi_50k", text, True), ("byte_bpe_50k", flat, text not in seen)):
            if keep:
                old = want.get((d.source, d.lang, v), (0, 0, 0))
                want[d.source, d.lang, v] = (old[0] + 1, old[1] + len(encoders[v].encode_ordinary(t)), old[2] + len(t))
        seen.add(text)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in queries.op4_token_counts(spark, SF).collect()}
    assert got == want


def test_token_counts_of_odd_rows(spark, wide, empty):
    v = {"byte_bpe_50k": token_counts.read_vocabulary(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken")}
    got = by_id(token_counts.with_token_counts(wide.withColumn("n_byte_bpe_50k", F.lit("x")), v))
    assert got[40].n_byte_bpe_50k == got[41].n_byte_bpe_50k == 0 and got[45].n_byte_bpe_50k >= 40_000
    assert token_counts.with_token_counts(empty, v).count() == 0
    both = token_counts.with_token_counts(wide.withColumns({"other": F.upper("text"), "N_UP": F.lit(1)}), v, also={"n_up": ("byte_bpe_50k", "other")})
    e = token_counts.encoding("byte_bpe_50k", v["byte_bpe_50k"])
    assert {r.doc_id: (r.n_byte_bpe_50k, r.n_up) for r in both.collect()} == {i: (len(e.encode_ordinary(t or "")), len(e.encode_ordinary((t or "").upper()))) for i, t, *_ in rows()}
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_vocabularies_of_one_name_and_size_are_told_apart():
    import base64

    one, two = (b"\n".join(base64.b64encode(x) + b" %d" % i for i, x in enumerate([*(bytes([c]) for c in range(256)), pair])) for pair in (b"ab", b"cd"))
    assert len(one) == len(two)
    assert [len(token_counts.encoding("v", v).encode_ordinary("ab")) for v in (one, two)] == [1, 2]


# mixing


def nonnegative_least_squares(a, b):
    """Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(20 * n):
        w = a.T @ (b - a @ x)
        if free.all() or w[~free].max() <= 1e-9 * np.abs(a.T @ b).max():
            break
        free[np.flatnonzero(~free)[w[~free].argmax()]] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if not (z[free] <= 0).any():
                break
            low = free & (z <= 0)
            x += (x[low] / (x[low] - z[low])).min() * (z - x)
            free &= x > 1e-12
        x = z
    return x


def errors_weighted(g):
    """A matrix whose square is G."""
    return np.linalg.cholesky(g).T if g.ndim == 2 else np.diag(np.sqrt(g))


def test_mixing_equals_brute_force(spark, wide):
    targets = {"s0": 1, "s1": 2, "s2": 1}
    out, report = mixing.mixed(wide.unionByName(wide.where("doc_id < 9")), targets, noise=0.1, temper=1.0)
    got = out.collect()
    assert len(got) == len(TEXTS) + 9 and report["converged"] and [c for c in out.columns if c.startswith("mix_")] == list(mixing._NEW)
    rows_ = mixing.described(wide.unionByName(wide.where("doc_id < 9")))
    key = ["_domain", *mixing._FEATURES]
    cells = rows_.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("docs"), F.sum("_tokens").cast("double").alias("tokens"))
    known, domains = mixing.posteriors(cells, noise=0.1)
    table = known.collect()
    p, t = np.array([r.p for r in table]), np.array([r.tokens for r in table])
    assert domains == ["s0", "s1", "s2"] and np.allclose(p.sum(1), 1)
    # naive Bayes, by hand
    labelled = [r for r in table if r._domain is not None]
    prior = np.array([sum(r.docs for r in labelled if r._domain == d) for d in domains])
    for row in table:
        logp = np.log((prior + 1) / (prior.sum() + 3))
        for f in mixing._FEATURES:
            bins = {r[f] for r in labelled}
            if row[f] in bins:
                logp += np.log((np.array([sum(r.docs for r in labelled if r._domain == d and r[f] == row[f]) for d in domains]) + 1) / (prior + len(bins) + 1))
        if row._domain is not None:
            logp += np.log([0.9 if d == row._domain else 0.05 for d in domains])
        q = np.exp(logp - logp.max())
        assert np.allclose(row.p, q / q.sum())
    # an independent solver of the same least squares reaches no less
    place = {tuple(r[k] for k in key): i for i, r in enumerate(table)}
    cell_of = {r._id: place[tuple(r[k] for k in key)] for r in rows_.collect()}
    rate = {cell_of[r.doc_id]: r.mix_rate for r in got}
    rates = np.array([rate[i] for i in range(len(table))])
    reached = (rates * t) @ p
    assert np.allclose(reached, report["reached"], rtol=1e-4)
    root = errors_weighted(mixing.weights_of(known, t @ p))
    best = nonnegative_least_squares(root @ (p * t[:, None]).T, root @ np.array(report["goal"]))
    assert np.allclose(reached, (best * t) @ p, rtol=1e-3)
    assert all(r.mix_rate >= 0 and abs(r.mix_copies - r.mix_rate) < 1 for r in got)


def made_cells(spark, *rows):
    return spark.createDataFrame(list(rows), "p array<double>, tokens double")


def test_mixing_is_the_least_squares_solution(spark, monkeypatch):
    """Targets that cannot all be met, as a domain has only documents shared with another; Lawson and Hanson reach the same."""
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-4)
    table = [([0.9, 0.05, 0.05], 900.0), ([0.5, 0.3, 0.2], 400.0), ([0.1, 0.8, 0.1], 30.0), ([0.3, 0.4, 0.3], 90.0)]
    fitted, report = mixing.fit_rates(made_cells(spark, *table), ["a", "b", "c"], {"c": 1.0})
    p, t = np.array([r[0] for r in table]), np.array([r[1] for r in table])
    root = errors_weighted(mixing.weights_of(made_cells(spark, *table), t @ p))
    best = nonnegative_least_squares(root @ (p * t[:, None]).T, root @ np.array([0.0, 0.0, t.sum()]))
    assert report["converged"] and np.allclose(report["reached"], (best * t) @ p, rtol=1e-3, atol=1e-3 * t.sum())
    assert report["miss"] > 0.01 and np.allclose(sum(r.rate * r.tokens for r in fitted.collect()), sum(report["reached"]))
    assert not mixing.fit_rates(made_cells(spark, *table), ["a", "b", "c"], {"c": 1.0}, rounds=2)[1]["converged"]


def test_mixing_with_bounds_descends_until_no_rate_moves(spark, monkeypatch):
    """A domain that cannot reach its target under a bound leaves the others to come as near as they can; numpy runs all steps."""
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-4)
    table = [([0.9, 0.05, 0.05], 900.0), ([0.5, 0.3, 0.2], 400.0), ([0.1, 0.8, 0.1], 30.0), ([0.1, 0.1, 0.8], 2.0), ([0.3, 0.4, 0.3], 90.0)]
    _, report = mixing.fit_rates(made_cells(spark, *table), ["a", "b", "c"], None, high=20.0)
    p, t = np.array([r[0] for r in table]), np.array([r[1] for r in table])
    g, goal, rate = mixing.weights_of(made_cells(spark, *table), t @ p), np.full(3, t.sum() / 3), np.ones(5)
    for _ in range(50_000):
        rate = np.clip(rate - 0.5 * p @ g @ ((rate * t) @ p - goal), 0, 20)
    assert report["converged"] and np.allclose(report["reached"], (rate * t) @ p, rtol=1e-3)


def test_mixing_rates_of_a_small_domain(spark):
    """A domain with a five-hundredth of its target's tokens reaches it: op7 puts no upper bound on rates."""
    fitted, report = mixing.fit_rates(made_cells(spark, ([0.99, 0.01], 9990.0), ([0.01, 0.99], 10.0)), ["a", "b"], None)
    assert np.allclose(report["reached"], report["goal"], rtol=1e-4) and fitted.agg(F.max("rate")).first()[0] > 100
    assert report["rounds"] < 30


def test_op7_puts_no_bound_on_rates(spark, tmp_path):
    docs = [(i, "a b " * 40, "big") for i in range(200)] + [(999, "ooo ooo ooo", "small")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op7_mixing(spark, str(tmp_path)).agg(F.max("rate")).first()[0] > 20


def test_op7_meets_its_targets(spark):
    """Expected tokens of all sources come out alike on the test table, where a rate moves every source a little."""
    out, report = mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), carry=["doc_id"])
    assert report["converged"] and report["miss"] < 1e-3 and report["rounds"] < 200
    assert out.columns == ["doc_id", *mixing._NEW] and out.agg(F.min("mix_rate")).first()[0] >= 0


def test_mixing_evidence_is_tempered_by_held_out_labels(spark):
    """Texts that tell their domain, with a share of wrong labels: the features repeat each other, so their evidence counts less
    than naive Bayes has it; texts that say nothing do not count."""
    r = random.Random(4)
    kinds = {"en": prose("en", 40), "xx": "é" * 300, "num": "1 2 3 4 " * 30}
    data = [(i, kinds[k], k if r.random() > 0.25 else r.choice([x for x in kinds if x != k])) for i, k in enumerate(r.choices(list(kinds), k=2500))]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    _, report = mixing.mixed(docs)
    assert 0 < report["temper"] < 1 and report["loss"] < 0.8 * report["share_loss"] and report["held_out"] > 400
    _, report = mixing.mixed(docs.withColumn("text", F.lit("all the same")))
    assert report["loss"] <= report["share_loss"] + 1e-9


def test_mixing_tokens_follow_a_tokenizer(spark):
    """Pieces of text against the counts of a byte-pair vocabulary, and a given column instead."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    v = {"byte_bpe_multi_50k": token_counts.read_vocabulary(f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")}
    true = by_id(token_counts.with_token_counts(docs, v))
    mine = {r._id: r._tokens for r in mixing.described(docs).collect()}
    pairs = np.array([(true[i].n_byte_bpe_multi_50k, n) for i, n in mine.items()], float)
    assert np.corrcoef(pairs.T)[0, 1] > 0.95
    given = mixing.with_rates(docs.withColumn("N", F.lit(7)), tokens_col="N")
    assert {r.mix_tokens for r in given.collect()} == {7}


def test_mixing_of_many_domains(spark):
    """Domains are rows: 400 of them are no plan of 400 columns."""
    cells = made_cells(spark, *[([0.9 if i == j else 0.1 / 399 for j in range(400)], 10.0 + i) for i in range(400)])
    _, report = mixing.fit_rates(cells, [str(i) for i in range(400)], None)
    assert report["converged"] and report["miss"] < 1e-3


def test_mixing_keeps_all_of_a_hot_source_and_reaches_targets(spark):
    """Rates of at least 1 with a source of 80 % of the tokens: the others grow until weights are alike."""
    cells = made_cells(spark, ([0.9, 0.05, 0.05], 800.0), ([0.05, 0.9, 0.05], 100.0), ([0.05, 0.05, 0.9], 100.0))
    fitted, report = mixing.fit_rates(cells, ["a", "b", "c"], None, budget=2.0, low=1.0)
    assert np.allclose(np.array(report["reached"]) / sum(report["reached"]), 1 / 3, rtol=0.01)
    assert fitted.agg(F.min("rate")).first()[0] >= 1 and report["converged"]


def test_mixing_does_not_double_in_vain(spark):
    """A domain that is in all others' documents cannot come down, whatever the budget: one doubling shows it."""
    cells = made_cells(spark, ([0.9, 0.1], 800.0), ([0.6, 0.4], 200.0))
    _, report = mixing.fit_rates(cells, ["a", "b"], None, budget=2.0, low=1.0)
    assert report["converged"] and report["miss"] > 0.1 and report["budget"] < 30


def test_pipeline_mixes_a_hot_source_to_its_target(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)).alias("source"))
    tokens = {r[0]: r[1] for r in corpus_pipeline.mix(spark, docs, SF).groupBy("source").agg(F.sum(F.col("mix_rate") * F.col("mix_tokens"))).collect()}
    assert len(tokens) == 5 and tokens["hot"] < 0.3 * sum(tokens.values())


def test_mixing_floor_and_empty(spark, docs, empty):
    kept = mixing.with_rates(docs.withColumn("MIX_RATE", F.lit("x")).withColumn("mix_other", F.lit(1)), budget=2.0, low=1.0)
    assert [c for c in kept.columns if c.lower().startswith("mix_")] == ["mix_other", *mixing._NEW]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    kept = kept.collect()
    assert len(kept) == len(TEXTS) and all(r.mix_rate >= 1 and r.mix_copies >= 1 for r in kept)
    assert mixing.with_rates(empty).count() == 0
    none = mixing.with_rates(docs.withColumn("source", F.lit(None).cast("string"))).collect()
    assert {r.mix_domain for r in none} == {""} and all(r.mix_rate == pytest.approx(1) for r in none)


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    two = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted({v[0] for v in brute_exact(texts.items()).values()})
    ids = sorted(texts)
    fps = np.array([simhash.fingerprint((texts[i] or "").encode()) for i in ids], np.uint64)
    three = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted({ids[j] for j in brute_components(fps)})
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    joined = {i: f" {' '.join(decontam.words_of(t))} " for i, t in texts.items()}
    leaked = {i for i, t in joined.items() if any(f" {' '.join(x)} " in t for x in items)}
    four = corpus_pipeline.decontaminate(spark, docs, SF)
    assert four.columns == docs.columns and leaked and leaked == set(texts) - {r.doc_id for r in four.collect()}
    five = corpus_pipeline.mix(spark, docs, SF)
    assert five.count() == len(texts) and five.where("mix_copies < 1").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert 0 < whole.count() < len(texts) and whole.select("doc_id").distinct().count() == whole.count()


def test_pipeline_of_odd_rows(spark, wide, empty):
    odd = wide.unionByName(wide.where("doc_id in (3, 45)")).unionByName(wide.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    df, gone = odd, empty
    for name, stage in corpus_pipeline.STAGES:
        df, gone = common.saved(stage(spark, df, SF), f"t-{name}"), stage(spark, gone, SF)
        assert gone.count() == 0
        if name != "mixing":
            assert df.columns == odd.columns and gone.columns == empty.columns
    ids = [r.doc_id for r in df.collect()]
    assert len(ids) == len(set(ids)) and {0, 3, 45} <= set(ids) and not {40, 41, 44, 46} & set(ids)


def test_dedup_stages_keep_texts_of_null_and_repeated_ids(spark):
    """Only rows that the operators mark as copies go, whatever their ids."""
    one, two, three, four = ("".join(random.Random(s).choices("abcdefghij ", k=4000)) for s in range(4))
    data = [(1, one), (None, one), (None, two), (None, three), (2, four), (2, "other words"), (2, "other  words"), (2, "other words")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = {(1, one), (None, two), (None, three), (2, four)}
    exact = list(map(tuple, corpus_pipeline.drop_exact_copies(spark, docs, SF).collect()))
    assert len(exact) == 5 and set(exact) == want | {(2, "other  words")}
    near = list(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, SF).collect()))
    assert len(near) == 5 and want < set(near)


def test_text_bytes_of_slices():
    a = pa.array(["ab", None, "é", ""])
    data, offsets = common.text_bytes(a.slice(1))
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2, 2]


def test_hash_index():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))
    index = numeric.HashIndex(keys[::2])
    assert (index.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (index.find(keys[1::2]) == -1).all()
    assert numeric.HashIndex(keys[:0]).find(keys).max() == -1
