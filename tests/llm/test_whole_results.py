"""Results that must not depend on ids, on the number of blocks or on the types of other columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import decontam, mixing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").cache(), spark.read.parquet(f"{SF}/benchmark.parquet").cache()


def leaks(docs, index):
    return sorted((r.doc_id, r.item_id is None, r.item_id or 0, round(r.score, 9), r.overlap, r.question_overlap, r.answer_overlap) for r in decontam.leaked_pairs(docs, index).collect())


def test_items_without_an_id_are_found_like_others(tables):
    docs, items = tables
    want = leaks(docs, decontam.build_index(items))
    got = leaks(docs, decontam.build_index(items.withColumn("item_id", F.lit(None).cast("long"))))
    assert want and sorted((d, *rest) for d, _, _, *rest in got) == sorted((d, *rest) for d, _, _, *rest in want)
    some = decontam.build_index(items.withColumn("item_id", F.when(F.col("item_id") % 2 == 0, F.col("item_id"))))
    assert len(leaks(docs, some)) == len(want)


def test_blocks_change_neither_leaks_nor_scores(tables):
    docs, items = tables
    odd = items.unionByName(items.limit(2).withColumn("item_id", F.lit(None).cast("long"))).unionByName(items.limit(1).withColumn("text", F.lit("")))
    want = leaks(docs, decontam.build_index(odd))
    for size in (20, 7):
        index = decontam.build_index(odd, block_items=size)
        assert len(index) > 1 and leaks(docs, index) == want
    assert decontam.build_index(items.limit(0), block_items=1).index(0).items == []


def test_dedup_stages_with_columns_of_any_type(spark):
    text = "some words of a text that is long enough to be looked at by all the stages here"
    rows = spark.createDataFrame([(1, text), (1, text), (1, f"{text} and some more words that make it another text altogether, really"), (2, None), (2, None), (None, "a text without an id, of which there are two"), (None, "a text without an id, of which there are two")], "doc_id long, text string")
    wide = rows.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.create_map(F.lit("k"), F.rand()).alias("scores"), F.struct(F.array(F.lit(1)), F.create_map(F.lit("a"), F.lit(2)).alias("inner")).alias("nested"), F.encode(F.lit("x"), "UTF-8").alias("raw"), F.lit(1.5).cast("decimal(5,2)").alias("_place"))
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        assert sorted((r.doc_id or 0, r.text or "")[0] for r in out.collect()) == [0, 1, 1, 2]


def told(i):
    """A text that tells which of three domains it is of."""
    n = 40 + i % 17
    return {0: "the other thing that they thought through " * n, 1: "мы пошли домой вечером все вместе " * n, 2: "1234567 98 7654 abcdxyzqwkjh lmnopqrs " * n}[i % 3]


def test_mixing_finds_the_noise_of_labels_where_the_text_tells(spark):
    names = ("a", "b", "c")
    rows = [(i, told(i), names[(i + (0 if i % 10 < 7 else 1 + i // 10 % 2)) % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, report = mixing.mixed(docs, low=0.0)
    assert abs(report["noise"] - 0.3) < 0.05 and report["loss"] < 0.8 * report["share_loss"] and report["sure"] > 50
    right = out.select((F.col("mix_domain") == F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 3 + 1).cast("int"))).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.8  # 0.7 by the labels
    clean = docs.withColumn("source", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 3 + 1).cast("int")))
    assert mixing.mixed(clean)[1]["noise"] == mixing.LEAST_NOISE
    silent = docs.withColumn("text", F.lit("one text for all of them"))
    assert mixing.mixed(silent)[1]["noise"] == mixing.LEAST_NOISE


def test_rows_without_an_id_and_repeated_rows_are_rounded_each(spark):
    rows = [(None if i % 2 else 7, f"some words and more {'x ' * (i % 5)}" if i % 3 else "one text", f"s{0 if i % 4 else 1}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, report = mixing.mixed(docs)
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.col("mix_tokens") * F.col("mix_copies")).alias("n")).collect()}
    want = out.groupBy("source").agg(F.sum(F.col("mix_tokens") * F.col("mix_rate")).alias("n")).collect()
    assert all(abs(got[r.source] / r.n - 1) < 0.1 for r in want)
