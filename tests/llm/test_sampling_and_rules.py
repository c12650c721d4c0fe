"""Importance resampling, the divergence audit and quality rules against brute force and SQL, with nulls, empty and
very long texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import collections
import math
import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import decision_list, divergence, queries, resampling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
LOWER = {c: c + 32 for c in range(65, 91)}

rng = random.Random(11)
WORDS = ["alpha", "Beta", "gamma", "straße", "ÉTÉ", "delta7", "x", "42", "omega", "łódź", "語", "zeta"]


def prose(n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


LONG = prose(30_000)
PASSAGE = prose(40)
ROWS = [
    *((i, prose(rng.randrange(60)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(120)),
    (200, None, "en", "s0"), (201, "", None, None), (202, " \n\t", "fr", "only"), (203, LONG, "en", "s1"), (204, LONG, "en", "s1"), (205, "语言" * 20 + " " + "y" * 300, "de", "s2"),
    (None, prose(30), "en", "s3"), (None, prose(30), "en", None), (7, prose(25), "en", "s0"), (7, prose(25), "en", "s0"), (8, PASSAGE, "de", "s1"), (8, PASSAGE, "de", "s1"),
    (9, "A\x0bB\x0cC one\ntwo two\n\ntwo two\n" * 9, "en", "s2"), (10, f"{PASSAGE} between {PASSAGE}", "en", "s2"), (11, "### *** |||\n" * 20, "en", "s2"), (-5, "a b c d e f " * 30, "", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def wide(docs):
    names = ("n_features", "weight", "Score", "rank", "_row", "_text", "n_words", "kept", "term", "g", "value", "_place", "_words", "prune", "bad", "text2")
    return docs.select("*", *(F.lit("x").alias(c) for c in names if c != "text2"), F.create_map(F.lit("k"), F.lit("v")).alias("text2"))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


# resampling


def brute_resampling(rows, target, percent=10, max_words=1, buckets=10_000):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        runs = [" ".join(w[i : i + n]) for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]
        return w, [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = (collections.Counter(b for x in texts for b in features(x)[1]) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for r in rows:
        words, found = features(r[1])
        weight = sum(map(gain, found))
        h = int(sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = percent * len(order) // 100
    return sorted(((*r[:4], i + 1 if i < k else None) for i, r in enumerate(order)), key=str) + sorted(((*r[:4], None) for r in out if not r[4]), key=str)


TARGET = [prose(200, ["alpha", "omega", "語"]), None, "", "gamma 42"]


@pytest.mark.parametrize(("percent", "max_words"), [(10, 1), (55, 2), (100, 1), (0, 1)])
def test_resampling_is_brute_force(spark, docs, percent, max_words):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = [tuple(r) for r in resampling.resampled(docs, target, percent=percent, max_words=max_words).collect()]
    assert sorted(got, key=str) == sorted(brute_resampling(ROWS, TARGET, percent, max_words), key=str)


def test_resampling_with_clashing_columns_and_empty_tables(spark, docs, wide, empty):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = resampling.resampled(wide, target, carry=wide.columns)
    assert out.count() == len(ROWS) and {"text2", "_row", "lang"} <= set(out.columns) and out.columns.count("rank") == 1
    assert resampling.resampled(empty, target).count() == 0
    assert resampling.resampled(docs, empty).where("rank is not null").count() == resampling.resampled(docs, target).where("rank is not null").count()


def test_resampling_ranks_repeated_rows_and_extreme_ids(spark):
    same = [(7, "a " * 30)] * 40 + [(2**63 - 1, "a " * 30), (-(2**63), "a " * 30), (0, "b " * 30)]
    out = resampling.resampled(spark.createDataFrame(same, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), percent=50)
    ranks = sorted(r.rank for r in out.collect() if r["rank"])
    assert ranks == list(range(1, 22)) and out.count() == 43


def test_checksums_of_spans():
    data = np.frombuffer(("ab" + "é" * 70 + "x" * 64).encode(), np.uint8)
    starts, lengths = np.array([0, 2, 142, 0, 1]), np.array([2, 140, 64, 0, 65])
    assert resampling.crc32s(data, starts, lengths).tolist() == [zlib.crc32(data[s : s + n]) for s, n in zip(starts, lengths, strict=True)]


def test_kth_key_for_every_k(spark):
    values = [(rng.randrange(-3, 3) * 10**rng.randrange(12), rng.choice([-(2**63), 0, 5, 2**63 - 1]), i) for i in range(60)]
    rows = spark.createDataFrame(values, "a long, b long, c long").cache()
    for k in (1, 2, 17, 30, 59, 60):
        assert sorted(map(tuple, rows.where(resampling.kth_key(rows, ["a", "b", "c"], k)).collect())) == sorted(values)[:k]


# divergence


def brute_divergence(rows, min_docs=3, top=200):
    docs, counts = collections.defaultdict(set), collections.defaultdict(collections.Counter)
    for i, (_, text, lang, source) in enumerate(rows):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        for w in words:
            docs[lang or "", w].add(i)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [w for (of, w), found in docs.items() if of == lang and len(found) >= min_docs]
        groups = {s: c for (of, s), c in counts.items() if of == lang}
        whole = sum(groups.values(), collections.Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        far = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pairs = [(-sum(far(p[s][w], p[o][w]) for w in kept), o) for o in groups if o != s]
            terms = [(-far(p[s][w], q[w]), w) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize(("block", "groups", "chunk", "top"), [(4096, 128, 1 << 24, 200), (3, 2, 500, 4), (2, 1, 1, 200)])
def test_divergence_is_brute_force_with_any_blocks(docs, monkeypatch, block, groups, chunk, top):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    assert sorted(map(tuple, divergence.divergence(docs, top=top).collect())) == brute_divergence(ROWS, top=top)


def test_divergence_with_clashing_columns_and_empty_tables(wide, docs, empty):
    assert sorted(map(tuple, divergence.divergence(wide).collect())) == brute_divergence(ROWS)
    assert divergence.divergence(empty).count() == 0
    none = divergence.divergence(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r.part, r.value) for r in none} == {("pair", 0)}


def test_shares_are_exact_beyond_64_bits():
    counts, whole = [0, 5, 10**10, 8 * 10**15, 123_456_789_012_345], 9 * 10**15
    assert divergence.shares(np.array(counts), np.int64(whole)).tolist() == [1 + 10**9 * (c + 1) // whole for c in counts]


# quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_are_brute_force(docs):
    got = sorted((r["_row"].doc_id is None, r["_row"].doc_id or 0, *r[1:6]) for r in decision_list.counted(docs, carry=["doc_id"]).collect())
    assert got == sorted((r[0] is None, r[0] or 0, *brute_counts(r[1])) for r in ROWS)
    assert not any(p in decision_list.counted(docs)._jdf.queryExecution().toString() for p in ("Python", "Arrow", "Pandas"))


def brute_rules(rows):
    """The same covering, over lists: rows of (values by feature, prune, bad, good)."""
    names = list(decision_list.features())

    def cuts(j):
        out = set()
        for part in (rows, [r for r in rows if r[2]]):
            v = sorted(r[0][j] for r in part)
            out |= {v[max(0, math.ceil(i / decision_list.CUTS * len(v)) - 1)] for i in range(decision_list.CUTS)} if v else set()
        return sorted(out)

    options = [(j, above, c) for j in range(len(names)) for c in cuts(j) for above in (True, False)]
    holds = lambda r, o: (r[0][o[0]] > o[2]) == o[1]
    count = lambda part: (sum(r[2] for r in part), sum(r[3] for r in part))
    rules, left = [], rows
    while len(rules) < decision_list.RULES:
        steps, worth, inside = [], [], left
        while len(steps) < decision_list.CONDITIONS:
            bad, good = count([r for r in inside if not r[1]])
            if not bad or not good:
                break
            gains = []
            for i, o in enumerate(options):
                b, g = count([r for r in inside if not r[1] and holds(r, o)])
                gains.append((b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good))) if b else -math.inf, -i))
            best, place = max(gains)
            if best <= 1e-9:
                break
            steps.append(options[-place])
            inside = [r for r in inside if holds(r, steps[-1])]
            b, g = count([r for r in inside if r[1]])
            worth.append(((b - g) / ((b + g) or 1), *count(inside)))
        if not steps:
            break
        at = max(range(len(steps)), key=lambda i: (worth[i][0], worth[i][1], -i))
        _, bad, good = worth[at]
        if (bad + 1) / (bad + good + 2) < decision_list.PRECISION:
            break
        rules.append(([(names[j], above, c) for j, above, c in steps[: at + 1]], bad, good))
        left = [r for r in left if not all(holds(r, s) for s in steps[: at + 1])]
    return rules


def test_rules_are_brute_force_and_hold_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    rows = decision_list.counted(docs, carry=["doc_id"]).cache()
    known = decision_list.labelled(rows, labels).where(~decision_list.base_failed())
    got = decision_list.learned(known)
    values = [([r[f"v{j}"] for j in range(9)], r.prune, r.bad, r.good) for r in known.select("*", *(c.alias(f"v{j}") for j, c in enumerate(decision_list.features().values()))).collect()]
    assert [([(c.feature, c.above, c.threshold) for c in r.conditions], r.bad, r.good) for r in got] == brute_rules(values)
    assert got and "drop if" in str(got[0])
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rules = decision_list.learned(decision_list.labelled(rows, labels.where(half)))
    judged = decision_list.labelled(decision_list.with_verdicts(rows, rules), labels.where(~half)).where("not base_failed")
    clean = judged.where("good > 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = judged.where("bad > 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.98 and junk < 0.1


def test_rules_with_odd_labels_clashing_columns_and_empty_tables(spark, docs, wide, empty):
    labels = spark.createDataFrame([(1, None), (None, 0), (7, 0), (7, 1), (99_999, 0), (2, 5)], "doc_id long, quality int")
    out, rules = decision_list.quality_rules(wide, labels, carry=wide.columns)
    assert rules == [] and out.count() == len(ROWS) and {"text2", "lang", "_row"} <= set(out.columns)
    base = {r.doc_id: r for r in out.where("base_failed").collect()}
    assert {200, 201, 202} <= set(base) and not any(r.kept for r in base.values()) and not out.where("kept = base_failed").count()
    assert decision_list.quality_rules(empty, labels)[0].count() == 0
    assert decision_list.quality_rules(docs, labels.limit(0))[0].where("kept").count() == out.where("not base_failed").count()


# queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_resampling", "op12_divergence"])
def test_queries_match_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_rules_query_reads_all_documents(spark):
    out = queries.QUERIES["op13_quality_rules"](spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in out.collect()}
    assert {i: tuple(r[1:6]) for i, r in got.items()} == {i: brute_counts(t) for i, t in texts.items()}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got.values())
    assert out.schema.simpleString() == "struct<doc_id:bigint,n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean>"
