"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All but the last
return the columns of documents, whatever other columns there are; the last adds the mixing columns. Rows without an id and
rows that share one are rows like others: dedup decisions are joined back by id and digest of the text, so only copies go.
An empty table stays empty in every stage, and very long texts go whole. No stage can be said in SQL as a whole
(trained models and iterations), so ORACLE_SQL is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontam, exact_dedup, langid, mixing, simhash
from vellum.llm.common import free_name, held_out, kept_texts, quoted, saved, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language (no letter, or no shorter to code than noise).

    Null and empty texts go, as they have no letter; with no labelled row at all no language is learned and all go;
    repeated rows are judged alike, and ids do not matter.
    """
    trees = langid.train(docs, ~held_out("doc_id", 4, 2))
    lang, score, bits = (free_name(c, docs) for c in ("_lang", "_score", "_bits"))
    marked = langid.with_language(docs, trees, pred_col=lang, score_col=score, bits_col=bits)
    return marked.where(~langid.rejected(lang, bits)).select(*map(quoted, docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document that stays of each class of equal texts: the longest as written, then the smallest id, null last.

    Null texts count as empty and equal each other; of repeated rows one stays; different texts under one id, or
    without one, all stay.
    """
    return kept_texts(docs, exact_dedup.exact_dedup(docs).where("kept"), exact_dedup.text_sha256())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash component, null last, then the smallest digest.

    Null and wordless texts are one component; of repeated rows one stays; a text under a repeated id is
    judged by its own fingerprint.
    """
    return kept_texts(docs, simhash.survivors(docs), simhash.text_sha256())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item's question and answer.

    Null and empty texts hold none and stay; repeated rows go or stay together; an empty benchmark drops nothing.
    """
    index = decontam.build_index(table(spark, sf_dir, "benchmark"))
    leaks = free_name("_leaks", docs)
    return decontam.with_leaks(docs, index, leaks_col=leaks).where(F.size(leaks) == 0).select(*map(quoted, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources to the same weight by rates of at least 1: every document stays, in mix_copies copies. The tokens
    are doubled, or multiplied by as much as the largest source asks for; a source that misses its target is warned of.

    Documents without a source are mixed by their text alone; null texts have no tokens and get the rate of their cell;
    repeated rows get one rate each.
    """
    return mixing.with_rates(docs, budget=2.0, low=1.0)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
