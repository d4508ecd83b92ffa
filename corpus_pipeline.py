"""A corpus pipeline: quality rules, near-duplicates, decontamination, privacy, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
docs, whatever they are called. An empty table stays one through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notegraph.llm import bpe, decontam, jaccard, pii, quality
from notegraph.llm.common import shipping, tables_let_go
from notegraph.llm.queries import RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules or the model reject go.

    Null and empty texts go, as those under 20 words do; very long ones are judged whole.
    Rows that repeat share their verdict; a score equal to the threshold stays.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard of five-word shingles >= 0.8) the row of the least doc_id stays.

    Candidates are links of SimHash fingerprints and, for what these cannot see, MinHash
    keys; all are verified. Null, empty and blank texts equal each other; of rows that
    repeat one stays. A row without doc_id stays only if its group has no other.
    """
    return jaccard.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go. Null and empty texts stay; rows that repeat share their verdict."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a tag of its kind. Null and empty texts stay as they are; n_chars follows the text."""
    return pii.redact_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, and the digests of the ids and of what they decode to. A null text has no ids."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.digest(bpe.encode(docs, ranks, pattern, decoded=True), "ids")


STAGES = [
    ("quality rules", shipping(quality_rules)),
    ("near-duplicates", shipping(near_duplicates)),
    ("decontamination", shipping(decontaminate)),
    ("private data", shipping(private_data)),
    ("tokens", shipping(tokens)),
]

#: Fingerprints, calibrated scores and merges are beyond SQL; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with tables_let_go(spark) as settle:
        for _, stage in STAGES[:-1]:
            docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
