"""The stored index against the search that makes its postings anew."""

import random

import pytest
from pyspark.sql import functions as F

from notegraph.operators import index, inverted, search, sqlsearch


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "stkm" for b in "aeiou" for c in "nrl"]
    rows = [(i, f"note {i}", " ".join(words[int(rng.paretovariate(0.7)) % len(words)] for _ in range(30)), ["x", rng.choice(words)]) for i in range(700)]
    return spark.createDataFrame(rows, "note_ord long, name string, summary string, tags array<string>").repartition(6)


QUERIES = [(0, "san rare"), (1, "note 77"), (2, "kel mul tin"), (3, "zzzz"), (4, ""), (5, "sanr x note")]


@pytest.mark.parametrize(("lead", "k"), [(5, 10), (300, 3), (1 << 40, 10)])
def test_same_rows_as_without_an_index(spark, notes, tmp_path, monkeypatch, lead, k):
    monkeypatch.setattr(index, "BLOCK", 64)
    held = index.write(notes, str(tmp_path / "index"))
    q = search.query_frame(spark, QUERIES)
    plain = lambda df: sorted((r.query_id, r["rank"], r.note_ord, round(r.score, 4)) for r in df.collect())
    assert plain(index.ngram_search(held, q, k, lead)) == plain(search.ngram_search(search.postings(notes), notes, q, k))


def test_only_asked_features_are_read(spark, notes, tmp_path):
    held = index.write(notes, str(tmp_path / "index"))
    asked = index._named(held.blocks, ["san", "77"])
    plan = asked._jdf.queryExecution().toString()
    assert "PushedFilters: [In(feature, [77,san])]" in plan or "In(feature, [san,77])" in plan
    assert asked.select("feature").distinct().count() == 2 and index._named(held.blocks, []).count() == 0
    # sorted by feature over all files: no two files' ranges of names overlap by more than their ends
    ends = held.blocks.groupBy(F.input_file_name().alias("f")).agg(F.min("feature").alias("a"), F.max("feature").alias("z")).orderBy("a").collect()
    assert all(x.z <= y.a for x, y in zip(ends, ends[1:]))
    assert held.blocks.agg(F.max(F.size("places"))).first()[0] <= index.BLOCK and held.n_notes.first()[0] == 700


def test_table_function_over_blocks_in_parts(spark, notes, tmp_path, monkeypatch):
    """Several rows a feature and block, as slices make them, change no answer of the table function."""
    monkeypatch.setattr(inverted, "SLICE", 3000)
    held = index.write(notes, str(tmp_path / "index"))
    rows = held.blocks.groupBy("kind", "feature", "block").count()
    assert rows.where("count > 1").count()
    sqlsearch.register(spark, held, "search_in_parts")
    q = search.query_frame(spark, QUERIES[:3])
    got = spark.sql("SELECT a.query_id, s.rank, s.note_ord, s.score FROM {a} a, LATERAL search_in_parts(a.query, 5) AS s", a=q).collect()
    want = search.ngram_search(search.postings(notes), notes, q, 5).select("query_id", "rank", "note_ord", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
