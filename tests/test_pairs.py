"""Queries on pairs return every pair, as plain loops find them; that none is shuffled, as folds tell them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notegraph import catalog
from notegraph.functions import text as T
from notegraph.operators import allpairs, graph, ingest
from notegraph.sources import tables
from test_allpairs import some_notes

SF = "/root/testdata/sf0.001"


def _pairs(spark, name, feature, score, least):
    rows = [(r.note_ord, r.dir, {*r.x}) for r in tables.notes(spark, SF).select("note_ord", "dir", feature.alias("x")).collect()]
    want = {(a, b): score(x, y) for a, d, x in rows for b, e, y in rows if d == e and a < b}
    want = {(*k, v) for k, v in want.items() if v >= least}
    got = [(r.a, r.b, r.score) for r in catalog.queries()[name](spark, SF).collect()]
    assert len(got) == len(want) > 0 and {(a, b, round(s, 9)) for a, b, s in got} == {(a, b, round(s, 9)) for a, b, s in want}


def _index(x, y):
    return np.floor(len(x & y) / len(x | y) * 1e4 + 0.5).item() / 1e4 if x & y else 0.0


def test_a_block_of_higher_ids_is_passed():
    schema = pa.schema([("id", pa.int64()), ("f", pa.list_(pa.int64()))])
    block = lambda rows: allpairs.Block(pa.RecordBatch.from_pylist([{"id": i, "f": f} for i, f in rows], schema), ["f"])
    x, y = block([(1, [1, 2]), (5, [1])]), block([(5, [1]), (3, [2]), (7, [1, 2])])
    fold = allpairs.Pairs(x, {"f": allpairs.overlap_least(1)}, lambda x, y, r, c, both: [*allpairs.ends(x, y, r, c), pa.array(both["f"])], ["a", "b", "n"], upward=True)
    rows = lambda y: sorted(tuple(r.values()) for b in fold.add(x, y) for r in b.to_pylist())
    assert rows(y) == [(1, 3, 1), (1, 5, 1), (1, 7, 2), (5, 7, 1)] and rows(block([(1, [1])])) == [] and fold.rows(x).num_rows == 0


def test_tag_jaccard_has_each_pair(spark):
    _pairs(spark, "tag_jaccard", F.col("tags"), _index, 0.25)


def test_summary_overlap_has_each_pair(spark):
    _pairs(spark, "summary_overlap", T.tokens(F.substring("summary", 1, 500)), lambda x, y: len(x & y), 3)


def test_ngram_jaccard_has_each_pair(spark):
    _pairs(spark, "ngram_jaccard", T.clean_grams(F.col("summary")), _index, 0.5)


def test_link_partial_has_each_pair_once(spark, monkeypatch):
    """A page of two targets that stand for one page lists it once; a page may stand for its own target."""
    links = spark.createDataFrame([("p", "ab"), ("p", "b c"), ("p", "zz"), ("xabx", "ab"), ("q", "none")], "src string, target string")
    names = spark.createDataFrame([("xabx",), ("AB c",), ("p",), ("",)], "name string")
    told = []
    was = graph.folded
    monkeypatch.setattr(graph, "folded", lambda own, table, *x, **k: (told.append((own.count(), table.count())), was(own, table, *x, **k))[1])
    got = sorted(map(tuple, graph.partial_links(links, names).collect()))
    assert got == [("p", "AB c"), ("p", "xabx"), ("xabx", "AB c"), ("xabx", "xabx")] and told == [(2, 2)]
    assert catalog.queries()["link_partial"](spark, SF).columns == ["src", "dst"]


@pytest.mark.parametrize("seed", [1, 2])
def test_sim_same_dir_has_each_pair(spark, seed):
    n = some_notes(spark, 70, random.Random(seed))
    want = [(r.src, r.dst, round(r.tag_jaccard, 4), r.token_overlap) for r in graph.same_dir_pairs(n).collect()]
    got = [(r.src, r.dst, round(r.tag_jaccard, 4), r.token_overlap) for r in graph.same_dir_links(n).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    assert catalog.queries()["sim_same_dir"](spark, SF).columns == ["src", "dst", "tag_jaccard", "token_overlap"]


def test_increment_edges_lists_each_edge(spark):
    n = some_notes(spark, 60, random.Random(7))
    new = n.where("note_ord % 3 = 0").select(F.concat(F.lit("new"), "name").alias("name"), "tags", "summary")
    links = new.select(F.col("name").alias("src"), F.explode(F.array(F.lit("m00"), F.lit("n01"), F.lit("zz"))).alias("target")).where("target <> 'n01' or src > 'newn03'")
    rows = lambda df: sorted((r.src, r.dst, r.kind, r.edge_ord or 0, int(r.weight * 1e4 + 0.5)) for r in df.collect())
    want = rows(ingest.new_edges(new, links, n))
    assert rows(ingest.listed_edges(new, links, n)) == want and {"pre", "sim"} == {k for _, _, k, _, _ in want} and any(not r[3] for r in want)


def test_edges_are_numbered_over_blocks():
    schema = pa.schema([("id", pa.string()), *((f, pa.list_(pa.int64())) for f in ("tags", "tokens", "g", "targets"))])
    block = lambda *ids: allpairs.Block(pa.RecordBatch.from_pylist([{"id": i, "tags": [1], "tokens": [], "g": [], "targets": [9]} for i in ids], schema), ["tags", "tokens", "g", "targets"])
    x = block("x", "c")
    fold = allpairs.Listed(x, lambda jac, o, ng: jac >= 0.4, lambda jac, o: np.full(len(jac), 7000.0), {"tags": 0.25, "g": 0.15}, 2)
    got = [tuple(r.values()) for y in (block("a", "b"), block("c", "d")) for b in fold.add(x, y) for r in b.to_pylist()]
    assert sorted(r for r in got if r[2] == "pre") == [("c", "a", "pre", 1, 1.0), ("c", "b", "pre", 2, 1.0), ("c", "d", "pre", 3, 1.0), *(("x", k, "pre", i, 1.0) for i, k in enumerate("abcd", 1))]
    assert [(r[1], r[3]) for r in got if r[0] == "x" and r[2] == "sim"] == [("a", 1), ("b", 2), ("c", None), ("d", None)] and {r[4] for r in got if r[2] == "sim"} == {0.7}


@pytest.mark.parametrize("seed", [3, 4])
def test_tag_links_are_the_tag_pairs(spark, seed, monkeypatch):
    """The same rows, found in tasks: no pair is joined."""
    n = some_notes(spark, 80, random.Random(seed))
    want = [(r.src, r.dst, round(r.tag_jaccard, 4), r.token_overlap) for r in graph.tag_pairs(n).collect()]
    got = [(r.src, r.dst, round(r.tag_jaccard, 4), r.token_overlap) for r in graph.tag_links(n).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    monkeypatch.setattr(graph, "_by_tags", None)
    assert catalog.queries()["sim_tags"](spark, SF).count() > 0
