"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import ann, html, langid, packing, pii, quality, sentencepiece_scan, sharding, simhash, suffix_dedup
from barloom.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.sharded(docs, sharding.default_shards()).select("doc_id", "source", "n_chars", "slot", "shard")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(pii.find(docs, pii.fit(docs)))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encoded(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.fit(docs))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 says of a text without its learned verdict."""
    names = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    return quality.judged(table(spark, sf_dir, "documents"), quality.DecisionList(())).select(*names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_html": op5_html,
    "op6_permutation_index": op6_permutation_index,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
    "quality_statistics": quality_statistics,
}

_PLACES = "".join(s.removeprefix("shard-") for s in sharding.lookup_table(sharding.default_shards()))
ORACLE: dict[str, str] = {
    # the table as text, three digits a slot: how shards fill it is a loop, which a test holds against its definition
    "op3_sharding": f"""select doc_id, source, n_chars, slot, 'shard-' || substr('{_PLACES}', 3 * slot + 1, 3) shard
from (select *, cast(coalesce(('0x' || substr(md5(cast(doc_id as varchar)), 1, 15))::bigint % {sharding.SLOTS}, 0) as integer) slot from documents)""",
    "quality_statistics": r"""with d as (select row_number() over () r, doc_id, coalesce(text, '') text from documents), w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from d),
win as (select r, i, array_to_string(list_slice(w, i, i + 7), ' ') g from w, unnest(range(1, len(w) - 6)) u(i)), rep as (select r, i from (select r, i, count(*) over (partition by r, g) n from win) where n > 1),
cov as (select r, count(distinct i + k) n from rep, range(0, 8) x(k) group by r), ln as (select r, l from d, unnest(string_split(text, chr(10))) u(l) where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct l) n from ln group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed
from (select d.doc_id, len(w.w) n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(cov.n, 0) n_repeat_words
  from d join w using (r) left join cov using (r) left join dup using (r))""".replace("\\\\", "\\"),
}
