"""What is written, read again."""

import json

from pyspark.sql import functions as F

from notegraph.operators import evaluate, feedback, iterate, sessions
from notegraph.sources import sinks


def test_notes_are_written_by_tasks_and_never_over(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old.md").write_text("mine")
    files = spark.createDataFrame([("a/old.md", "theirs"), ("a/new.md", "né"), ("b c/架构 #1.md", "x\ny"), ("top.md", None)], "path string, text string").repartition(3)
    assert sinks.write_notes(files, f"file://{tmp_path}") == 3 and sinks.write_notes(files, str(tmp_path)) == 0
    read = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert read == {"a/old.md": "mine", "a/new.md": "né", "b c/架构 #1.md": "x\ny", "top.md": ""}
    assert sinks.write_notes(files.limit(0), str(tmp_path)) == 0


def test_pagerank_is_a_table_of_its_own(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "a")], "src string, dst string").select("src", "dst", F.lit("pre").alias("kind"), F.lit(1.0).alias("w"))
    ranks = iterate.pagerank(edges)
    sinks.write_pagerank(ranks, str(tmp_path / "pagerank"))
    held = spark.read.parquet(str(tmp_path / "pagerank"))
    assert held.columns == ["name", "pagerank"] and [r.name for r in held.orderBy(F.desc("pagerank")).collect()][0] == "b" and held.count() == 3
    notes = spark.createDataFrame([("a", 1), ("nobody", 2)], "name string, note_ord int")
    got = {r.name: r.pagerank for r in sinks.with_pagerank(notes, held).collect()}
    assert got["nobody"] == 0.0 and got["a"] == held.where("name = 'a'").first().pagerank


def test_tables_and_reports_are_replaced(spark, tmp_path):
    index = spark.createDataFrame([("n", "s" * 300, ["t"])], "name string, summary string, tags array<string>")
    for summary in (300, 120):
        sinks.write_table(index.withColumn("summary", F.substring("summary", 1, summary)), str(tmp_path / "meta"))
    assert [len(r.summary) for r in spark.read.parquet(str(tmp_path / "meta")).collect()] == [120]
    metrics = spark.createDataFrame([(1, 0.5)], "query_id long, f1 double")
    paths = [sinks.save_report(metrics, str(tmp_path), stamp) for stamp in ("20240101", "20240102")]
    assert [p.rpartition("/")[2] for p in paths] == ["eval-20240101", "eval-20240102"]
    assert [r.asDict() for r in spark.read.json(paths[0]).collect()] == [{"query_id": 1, "f1": 0.5, "stamp": "20240101"}]
    assert sinks.file_name("架构 / a?b") == "架构_a_b" and sinks.file_name("??") == "query"


def test_edges_as_text_and_records(spark, tmp_path):
    texts = ["a||b||pre", "a||b", "a||b||c||pre", "a||b||other", "||b||pre", "a||||sim", "a b||c||sim", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", feedback.parse_edge(F.col("t")).alias("e"))
    assert {r.i: tuple(r.e) for r in df.where("e is not null").collect()} == {0: ("a", "b", "pre"), 6: ("a b", "c", "sim")}
    asked = spark.createDataFrame([("s", "2024-01-31T00:00:00Z", "q", ["a||b||pre", "a||b||pre"], ["a||b||pre", "c||d||sim", "e||f||pre"])], "session_id string, at string, query string, used array<string>, left array<string>")
    edges = lambda c: F.filter(F.transform(c, feedback.parse_edge), lambda e: e.isNotNull())
    record = asked.select(*feedback.record(F.col("session_id"), F.col("at"), F.col("query"), F.lit(True), edges("used"), edges("left"), cap=1))
    sinks.append_feedback(record, str(tmp_path / "log"))
    r = json.loads("".join(p.read_text() for p in (tmp_path / "log").glob("part-*")))
    assert (r["consumed_count"], r["ignored_count"], len(r["ignored_edges"])) == (1, 2, 1) and r["consumed_edges"] == [{"from": "a", "to": "b", "type": "pre"}]


def test_given_relations_stand_where_a_source_is_missing(spark):
    """Relations that a caller supplies merge with found ones as a source of their own."""
    given = spark.createDataFrame([("Alpha", "Beta", "similarity"), ("Alpha", "Gamma", "prerequisite")], "a string, b string, type string")
    found = spark.createDataFrame([("alpha", "beta", "similarity"), ("Delta", "Beta", "similarity")], given.schema)
    merged = sorted(map(tuple, sessions.merge_relations(found, given).collect()))
    assert merged == [("Alpha", "Gamma", "prerequisite"), ("Delta", "Beta", "similarity"), ("alpha", "beta", "similarity")]
    notes = spark.createDataFrame([(1, "alpha", "x/alpha.md"), (2, "gamma notes", "x/gamma.md"), (3, "beta", "beta.md")], "note_ord long, name string, path string")
    assert sorted(map(tuple, sessions.match_relations(sessions.merge_relations(given.limit(0), given), notes).collect())) == [("alpha", "beta", "similarity"), ("alpha", "gamma notes", "prerequisite")]


def test_evaluation_from_a_file(spark, tmp_path):
    from notegraph.sources import readers

    (tmp_path / "eval.json").write_text(json.dumps([{"id": 1, "query": "x", "type": "t", "relevant": ["a", "b"], "notes": ""}, {"id": 2, "query": "y", "type": "u", "relevant": ["z"]}]))
    asked = readers.read_eval(spark, str(tmp_path / "eval.json"))
    relevant = asked.select(F.col("id").cast("long").alias("query_id"), F.explode("relevant").alias("name"))
    returned = spark.createDataFrame([(1, 1, "c"), (1, 2, "a"), (2, 1, "q")], "query_id long, rank int, name string")
    got = {r.query_id: (r.precision, r.recall, r.mrr) for r in evaluate.metrics(returned, relevant).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0)}
