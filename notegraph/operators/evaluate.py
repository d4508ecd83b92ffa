"""Retrieval quality: precision, recall, F1 and reciprocal rank at k, with averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.substrings import contained


def holders(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """texts(name, t), passages(query_id, text) -> query_id, name of every text that holds a passage verbatim; texts stay where they lie."""
    found = contained(passages.select(F.col("query_id").alias("n"), F.col("text").alias("s")), texts.select(F.col("name").alias("h"), "t"))
    return found.select(F.col("n").alias("query_id"), F.col("h").alias("name"))


def round3(c):
    return F.floor(c * 1000.0 + 0.5) / 1000.0


def metrics(returned: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """returned(query_id, rank, name), relevant(query_id, name) -> a row a query of relevant."""
    want = relevant.distinct()
    top = returned.where(F.col("rank") <= k)
    n_want = want.groupBy("query_id").agg(F.count("*").alias("total_relevant"))
    n_got = top.groupBy("query_id").agg(F.count("*").alias("returned"))
    hits = top.join(want, ["query_id", "name"], "left_semi").groupBy("query_id").agg(F.count_distinct("name").alias("tp"), F.min("rank").alias("first_hit_rank"))
    out = n_want.join(n_got, "query_id", "left").join(hits, "query_id", "left").fillna(0, ["tp", "returned"])
    p = F.when(F.col("returned") > 0, F.col("tp") / F.least(F.lit(k), F.greatest(F.lit(1), F.col("returned")))).otherwise(0.0)
    r = F.col("tp") / F.greatest(F.lit(1), F.col("total_relevant"))
    out = out.withColumns({"p": p, "r": r})
    f1 = 2 * F.col("p") * F.col("r") / F.greatest(F.lit(0.001), F.col("p") + F.col("r"))
    rr = F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0))
    return out.select("query_id", "tp", "first_hit_rank", round3(F.col("p")).alias("precision"), round3(F.col("r")).alias("recall"), round3(f1).alias("f1"), round3(rr).alias("mrr"))


def averages(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Means of the rounded values, hit and zero-recall counts; over everything or by a column."""
    sums = [F.count("*").alias("n"), *(round3(F.avg(c)).alias(f"mean_{c}") for c in ("precision", "recall", "f1", "mrr"))]
    sums += [F.count_if(F.col("tp") > 0).alias("hits"), F.count_if(F.col("recall") == 0).alias("zero_recall")]
    return rows.groupBy(by).agg(*sums) if by else rows.agg(*sums)


def compare(runs: dict[str, DataFrame], relevant: DataFrame, k: int = 5) -> DataFrame:
    """Averages of several modes under their names."""
    out = None
    for mode, returned in runs.items():
        one = averages(metrics(returned, relevant, k)).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out
