"""A registry of search engines, and what outside providers hand in."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = "query_id long, hit_ord long, title string, path string, source string, score double, snippet string"
Engine = Callable[[DataFrame], DataFrame]

PAIR = "struct<`from`:string,`to`:string,reason:string,strength:string>"
EXTRACTION = f"struct<prerequisite:array<{PAIR}>,similarity:array<{PAIR}>,concepts:array<struct<concept:string,appears_in:array<string>,description:string>>>"


def fan_out(engines: Mapping[str, Engine | None], queries: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All engines' hits with engine_ord in the registry's order, and what became of each engine.

    An engine that is None is disabled; one that fails adds no hits and does not stop the others.
    """
    out, state = queries.sparkSession.createDataFrame([], f"engine_ord int, {HITS}"), {}
    for i, (name, engine) in enumerate(engines.items(), 1):
        if engine is None:
            state[name] = "disabled"
            continue
        try:
            hits = engine(queries)
            out = out.unionByName(hits.withColumn("engine_ord", F.lit(i)).select(*out.columns))
            state[name] = "ok"
        except Exception as e:  # an engine may be any code
            state[name] = f"failed: {str(e)[:100]}"
    return out, state


def encoded(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", out: str = "embedding") -> DataFrame:
    """texts with unit vectors by an outside encoder, in Arrow batches: rows of floats for rows of texts. A null text is the empty one."""

    @F.pandas_udf("array<float>")
    def encode(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        v = np.asarray(encoder(batch.fillna("").tolist()), np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list((v / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return texts.withColumn(out, encode(F.col(text)))


def counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


def prompts(numbered: DataFrame, size: int = 8, chars: int = 1500) -> DataFrame:
    """One prompt a batch of strategic notes(name, text, strategic_ord): batch_id, prompt."""
    part = F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.substring("text", 1, chars))
    rows = F.array_sort(F.collect_list(F.struct("strategic_ord", part.alias("part"))))
    head = "List prerequisite pairs, similar pairs and concepts of these notes as JSON.\n\n"
    return numbered.groupBy(F.floor((F.col("strategic_ord") - 1) / size).alias("batch_id")).agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n")).alias("prompt"))


def parse_answer(text: Column) -> Column:
    """The JSON of a provider's answer, with or without a code fence; null if it is none."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    a = F.from_json(F.when(fenced != "", fenced).otherwise(text), EXTRACTION)
    return F.when(F.coalesce(a["prerequisite"].isNotNull() | a["similarity"].isNotNull() | a["concepts"].isNotNull(), F.lit(False)), a)


def answered_edges(answers: DataFrame) -> DataFrame:
    """answers(batch_id, text) to src, dst, kind, reason, strength."""
    parsed = answers.select(parse_answer(F.col("text")).alias("a")).where("a is not null")
    none = F.array().cast(f"array<{PAIR}>")
    pairs = lambda c, kind: F.transform(F.coalesce(c, none), lambda p: F.struct(p["from"].alias("src"), p["to"].alias("dst"), F.lit(kind).alias("kind"), p["reason"].alias("reason"), p["strength"].alias("strength")))
    every = F.concat(pairs(F.col("a.prerequisite"), "pre"), pairs(F.col("a.similarity"), "sim"))
    return parsed.select(F.explode(every).alias("e")).select("e.*").where("src is not null and dst is not null")


def concepts(answers: DataFrame) -> DataFrame:
    """Distinct concepts of all answers."""
    return answers.select(parse_answer(F.col("text")).alias("a")).select(F.explode("a.concepts").alias("c")).select("c.*").distinct()


def unprocessed(numbered: DataFrame, answers: DataFrame, size: int = 8) -> DataFrame:
    """Notes of batches without a readable answer: a failed batch is asked again."""
    done = answers.where(parse_answer(F.col("text")).isNotNull()).select("batch_id").distinct()
    return numbered.withColumn("batch_id", F.floor((F.col("strategic_ord") - 1) / size)).join(done, "batch_id", "left_anti").drop("batch_id")


def cited(text: Column, title: Column) -> Column:
    """Whether a text names a note, with or without its extension."""
    return (title != "") & F.contains(text, title)


def best_skills(scored: DataFrame, k: int = 8) -> DataFrame:
    return scored.where(F.col("score") > 0).orderBy(F.col("score").desc(), "skill_id").limit(k)
