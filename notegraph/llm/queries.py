"""The operators of this package bound to the test tables, one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm import bpe, conversations, decontam, kneser_ney, licenses, pii, quality, schema_drift, sentence_spans, simhash, suffix_dedup, toxicity, url_filter
from notegraph.llm.common import crc_mod, cut, shipping

#: Documents as files: each source a tree, every tenth a licence file of its own directory, every hundredth of the one above.
FILES_SQL = """SELECT doc_id, text, source || '/' || CAST(floor(doc_id / 100) AS BIGINT) ||
  CASE WHEN doc_id % 100 = 0 THEN '/LICENSE' WHEN doc_id % 10 = 0 THEN '/' || CAST(floor(doc_id / 10) AS BIGINT) || '/LICENSE.txt'
  ELSE '/' || CAST(floor(doc_id / 10) AS BIGINT) || '/' || doc_id || '.md' END AS path FROM documents"""
#: (verdict, host, path) for urls.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.digest(toxicity.score(docs, model))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.digest(sentence_spans.remove_repeated_spans(_table(spark, sf_dir, "documents")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.digest(bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern, decoded=True))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    model = kneser_ney.fit(docs, ~held_out)
    return kneser_ney.score(docs, model).withColumn("held_out", held_out)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    group = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).when(F.col("doc_id") % 10 == 0, F.concat(group(10), F.lit("/LICENSE.txt")))
    name = name.otherwise(F.concat(group(10), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return licenses.scan(docs.select("doc_id", "text", F.concat_ws("/", "source", group(100), name).alias("path")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan_pii(_table(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.digest(quality.judge(docs, model))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.find_matches(docs, _table(spark, sf_dir, "benchmark")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_components(cut(simhash.fingerprints(_table(spark, sf_dir, "documents")))))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages.select("page_id", "url"), URL_RULES, texts=pages.select("html")).select("page_id", "host", "path", "rule", "verdict", "block_odds")


def op12_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.rewrite_clients(_table(spark, sf_dir, "clients"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = _table(spark, sf_dir, "conversations")
    return conversations.digest(original, conversations.repair(conversations.damaged(original)))


OPERATORS = (
    op1_toxicity, op2_sentence_spans, op3_byte_bpe, op4_kneser_ney, op5_licenses, op6_pii, op7_suffix_dedup, op8_quality_rules, op9_decontamination, op10_simhash,
    op11_url_filters, op12_schema_drift, op13_conversations,
)


def queries() -> dict:
    return {f.__name__: shipping(f) for f in OPERATORS}


def oracle_sql() -> dict:
    return {"op5_licenses": licenses.oracle(FILES_SQL), "op9_decontamination": decontam.oracle()}
