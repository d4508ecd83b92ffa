"""Settings layers, engines, provider answers and sinks."""

import json

from pyspark.sql import functions as F

from notegraph.operators import engines, search
from notegraph.settings import DEFAULT
from notegraph.sources import config, sinks


def test_layers():
    base = config.parse_flat("# c\nmax_depth: 4\ncold_days: '10'  # days\nnested:\n  x: 1\nempty:\n")
    assert base == {"max_depth": "4", "cold_days": "10"}
    s = config.settings(base, {"cold_days": "20"}, env={"NOTEGRAPH_MAX_WEIGHT": "3.5", "OTHER": "1"})
    assert (s.max_depth, s.cold_days, s.max_weight, s.min_weight) == (4, 20, 3.5, DEFAULT.min_weight)


def test_engines_fail_alone(spark):
    q = search.query_frame(spark, [(0, "x")])

    def good(queries):
        return queries.select("query_id", F.lit(1).alias("hit_ord"), F.lit("T").alias("title"), F.lit("p").alias("path"), F.lit("lines").alias("source"), F.lit(0.7).alias("score"), F.lit("s").alias("snippet"))

    def bad(queries):
        raise RuntimeError("down")

    hits, state = engines.fan_out({"good": good, "bad": bad, "visual": None}, q)
    assert state == {"good": "ok", "bad": "failed: down", "visual": "disabled"}
    assert [(r["engine_ord"], r["title"]) for r in hits.collect()] == [(1, "T")] and engines.counts(hits).first()["n"] == 1


def test_answers(spark):
    good = {"prerequisite": [{"from": "a", "to": "b", "reason": "r"}], "similarity": [{"from": "a", "to": "c", "strength": "strong"}], "concepts": [{"concept": "k", "appears_in": ["a"], "description": "d"}]}
    rows = [(0, "```json\n" + json.dumps(good) + "\n```"), (1, "no json"), (2, json.dumps(good))]
    answers = spark.createDataFrame(rows, "batch_id long, text string")
    got = {(r["src"], r["dst"], r["kind"], r["reason"], r["strength"]) for r in engines.answered_edges(answers).collect()}
    assert got == {("a", "b", "pre", "r", None), ("a", "c", "sim", None, "strong")} and engines.concepts(answers).count() == 1
    numbered = spark.createDataFrame([(f"n{i}", "text", i + 1) for i in range(20)], "name string, text string, strategic_ord long")
    assert {r["name"] for r in engines.unprocessed(numbered, answers).collect()} == {f"n{i}" for i in range(8, 16)}
    p = engines.prompts(numbered).orderBy("batch_id").collect()
    assert len(p) == 3 and p[2]["prompt"].count("## ") == 4


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([(1, 0.5, "a", "lines"), (2, 0.25, "b", "graph")], "rank int, score double, title string, source string")
    path = sinks.save_results(hits, str(tmp_path), "what is / this?")
    assert path.endswith("what_is_this") and spark.read.json(path).count() == 2
    assert sinks.listing(hits.collect()).splitlines()[0] == " 1. 0.500  a  [lines]"
    sinks.append_feedback(hits, str(tmp_path / "log"))
    sinks.append_feedback(hits, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    steps = spark.createDataFrame([("start", 0, 0.5), ("base", 2, 0.3)], "name string, depth int, rank_score double").collect()
    assert sinks.reading_path(steps) == "base → start"
    index = spark.createDataFrame([(1, "gram", "ab"), (2, "gram", "bc")], "note_ord long, kind string, feature string")
    sinks.write_postings(index, "postings_test", str(tmp_path / "postings"), 4)
    assert spark.table("postings_test").where("feature = 'ab'").count() == 1
