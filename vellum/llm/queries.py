"""The corpus operators as queries over the test tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decision_list, decontam, divergence, exact_dedup, langid, mixing, quality, resampling, simhash, suffix_dedup, token_counts, toxicity
from .common import held_out, saved, spread_join, table, work_path

#: Where the public vocabulary files are; a parameter of op4's operator, never copied here.
TOKENIZERS = "/opt/tokenizers"

_CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.with_toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.with_quality(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """All documents under two vocabularies; texts with other white space than single spaces are then revised
    to their collapsed form under the first one, and later copies of a text deleted from it. A batch is sent twice."""
    one, two = "byte_bpe_50k", "byte_bpe_multi_50k"
    vocabularies = {v: token_counts.read_vocabulary(f"{folder}/{v}.tiktoken") for v in (one, two)}
    text = F.coalesce("text", F.lit(""))
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(text, 256).alias("sha"), F.length(text).alias("n_chars"), F.length(flat).alias("flat_chars"), (text == flat).alias("is_flat"), text.alias("text"), F.when(text != flat, flat).alias("flat"))
    counts = token_counts.with_token_counts(docs, vocabularies, also={f"flat_{one}": (one, "flat")})
    counts = saved(counts.withColumn("flat_tokens", F.when(F.col("is_flat"), F.col(f"n_{one}")).otherwise(F.col(f"flat_{one}"))), "token-counts")
    rollup = token_counts.Rollup(spark, work_path(spark, "rollup"))
    load = token_counts.change(counts, 1, one, f"n_{one}").unionByName(token_counts.change(counts, 1, two, f"n_{two}"))
    revise = token_counts.revision(counts, one, (f"n_{one}", "n_chars"), ("flat_tokens", "flat_chars"))
    first = counts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    copies = spread_join(counts, first, "sha").where("doc_id > first")
    delete = token_counts.change(copies, -1, one, "flat_tokens", "flat_chars")
    for batch, changes in (("load", load), ("load", load), ("revise", revise), ("delete", delete)):
        rollup.apply(batch, changes)
    rollup.compact()
    return rollup.totals()


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    trees = langid.train(docs, ~out)
    return langid.with_language(docs.select("doc_id", "text"), trees).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(turns.withColumn("conv_id", F.col("conv_id").cast("long")).unionByName(planted)))


OP8_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over () as lone from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]', 0 union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]', 0
), e as (
  select *,
    length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')) + 24 as n
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from e group by conv_id, case when conv_id is null then lone end
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
w as (select doc_id, first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size, sha256(norm) as text_sha256 from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w
"""

def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to the same weight, with rates open above."""
    mixed = mixing.with_rates(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_domain").alias("domain"), F.col("mix_posterior").alias("posterior"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(table(spark, sf_dir, "benchmark"))
    return decontam.leaked_pairs(table(spark, sf_dir, "documents"), index)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 in SQL: the table by its rule, then a fold over the bytes of each distinct word.
OP11_SQL = rf"""
with crc as materialized (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), d as materialized (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as materialized (select unnest(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
dw as materialized (select doc_id, unnest(w) as w from d),
codes as materialized (
  select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::bigint)),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket
  from (select w from dw union select w from b), crc
), s as (select bucket, count(*) as s from dw join codes using (w) group by 1), t as (select bucket, count(*) as t from b join codes using (w) group by 1),
g as (
  select bucket, cast(floor(1000 * ln(cast((coalesce(t, 0) + 1) * ((select count(*) from dw) + 10000) as double) / cast((coalesce(s, 0) + 1) * ((select count(*) from b) + 10000) as double))) as bigint) as gain
  from s full join t using (bucket)
), sums as (select doc_id, cast(sum(gain) as bigint) as weight from dw join codes using (w) join g using (bucket) group by 1),
scored as (
  select doc_id, len(w) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as score
  from d left join sums using (doc_id)
), ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as r, count(*) over (partition by n_features >= 20) as n from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and r <= 10 * n // 100 then r end as rank from ranked
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
with d as materialized (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), w as materialized (select r, lang, source, unnest(w) as term from d),
kept as materialized (select lang, term, count(*) as lang_n from w group by 1, 2 having count(distinct r) >= 3),
v as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as n from kept group by 1),
c as materialized (select lang, source, term, count(*)::hugeint as n from w join kept using (lang, term) group by all),
g as materialized (select lang, source, coalesce(t, 0)::hugeint as t from (select distinct lang, source from d) left join (select lang, source, sum(n) as t from c group by 1, 2) using (lang, source)),
p as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.t + v.v) as p, 1 + 1000000000::hugeint * (k.lang_n + 1) // (v.n + v.v) as q
  from g join kept k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
), terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from every union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = decision_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_resampling": op11_resampling,
    "op12_divergence": op12_divergence,
    "op13_quality_rules": op13_quality_rules,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op8_chat_format": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_resampling": OP11_SQL, "op12_divergence": OP12_SQL}
