"""Sources over generated files, and search as SQL."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from notegraph.operators import index, search, sqlsearch
from notegraph.sources import skills


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skills") / "skills.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE a_counts (n INTEGER)")
        con.execute('CREATE TABLE skills (skill_id INTEGER PRIMARY KEY, name TEXT, doc VARCHAR(20), "used at" REAL, raw BLOB)')
        con.executemany("INSERT INTO skills VALUES (?, ?, ?, ?, ?)", [(i * 3 + 1, f"skill {i}", None if i % 5 == 0 else f"how to {'Sort' if i % 2 else 'sort'} {i}", i / 2, bytes([i % 256])) for i in range(1000)])
        con.execute("INSERT INTO skills VALUES (9999, 12345, 'a number for a name', 'no number', NULL)")
        con.execute("CREATE TABLE z_empty (x TEXT)")
    return path


def test_skill_store_columns_and_rows(spark, store):
    df = skills.read_skills(spark, store, parts=5)
    assert df.dtypes == [("skill_id", "bigint"), ("name", "string"), ("doc", "string"), ("used at", "double"), ("raw", "binary")]
    assert df.count() == 1001 and df.rdd.getNumPartitions() == 5
    assert df.where("skill_id = 9999").select("name", "used at", "raw").first() == ("12345", 0.0, None)
    assert skills.read_skills(spark, store, "z_empty").count() == 0
    with pytest.raises(Exception, match="no table with text"):
        skills.read_skills(spark, store, "a_counts").count()


@pytest.mark.parametrize("where", ["skill_id > 2500", "doc IS NULL", "doc IS NOT NULL AND name = 'skill 7'", "contains(doc, 'Sort')", "startswith(doc, 'how to s')", "name IN ('skill 1', 'skill 999', 'x')", "name <=> NULL", "`used at` <= 2.5", "length(doc) = 12", "doc LIKE '%7'"])
def test_filters_are_answered_as_by_spark(spark, store, where):
    df = skills.read_skills(spark, store)
    plain = df.coalesce(1).withColumn("_n", F.monotonically_increasing_id())  # filters stay above this
    assert sorted(r.skill_id for r in df.where(where).collect()) == sorted(r.skill_id for r in plain.where(where).collect())


def test_filters_go_to_the_store(store):
    name, schema = skills.discover(store, None)
    reader = skills.SkillReader(store, name, schema, 3)
    left = list(reader.pushFilters([skills.GreaterThan(("skill_id",), 2900), skills.StringContains(("doc",), "Sort"), skills.EqualTo(("raw",), b"x")]))
    assert name == "skills" and len(left) == 1 and len(reader.conditions) == 2
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["skill_id"] for r in rows} == {i * 3 + 1 for i in range(1000) if i * 3 + 1 > 2900 and i % 5 and i % 2}


def test_skill_scan_over_the_store(spark, store):
    hits = search.skill_scan(skills.read_skills(spark, store).drop("raw", "used at"), search.query_frame(spark, [(0, "SORT 77"), (1, "none of it")]))
    assert [(r.query_id, r.skill_id, r.score) for r in hits.where("rank = 1").collect()] == [(0, 232, 0.6)]


def test_search_as_sql(spark, tmp_path):
    notes = spark.createDataFrame([(i, f"note {i}", f"about {w} and {w}s, number {i}", [w]) for i, w in enumerate(["graph", "engine", "garden", "图 数据", "graph engine"] * 9)], "note_ord long, name string, summary string, tags array<string>")
    sqlsearch.register(spark, index.write(notes, str(tmp_path / "index")), "find_notes")
    want = search.ngram_search(search.postings(notes), notes, search.query_frame(spark, [(0, "Graph engine"), (1, "数据 7")]), 4)
    want = sorted((r.query_id, r["rank"], r.note_ord, r.score) for r in want.collect())
    one = [(0, *r) for r in spark.sql("SELECT * FROM find_notes('Graph engine', 4)").collect()]
    assert sorted(one) == [r for r in want if r[0] == 0]
    many = spark.sql("SELECT q.i, s.* FROM VALUES (0, 'Graph engine'), (1, '数据 7'), (2, '') AS q(i, text), LATERAL find_notes(q.text, 4) AS s")
    assert sorted(map(tuple, many.collect())) == want
