"""Folds over all pairs against plain loops, and that nothing grows with the pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notegraph.operators import allpairs, graph, ingest, search, sessions, substrings


def some_notes(spark, n, rng, dirs=3):
    rows = []
    for i in range(n):
        summary = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa", "lambda"]) for _ in range(rng.randint(0, 6)))
        tags = sorted({rng.choice("abcdef") for _ in range(rng.randint(0, 4))})
        rows.append((f"n{i:03d}", i, rng.choice([None, *(f"d{k}" for k in range(dirs))]), tags, summary))
    rows += [(f"m{i:03d}", 1000 + i, "d0", ["a", "b"], "alpha beta gamma") for i in range(15)]  # copies
    return spark.createDataFrame(rows, "name string, note_ord long, dir string, tags array<string>, summary string")


@pytest.mark.parametrize("dense", [0.0, 0.004, 2.0])
def test_shared_against_sets(monkeypatch, dense):
    monkeypatch.setattr(allpairs, "_DENSE", dense)
    monkeypatch.setattr(allpairs, "_AT_ONCE", 50)
    monkeypatch.setattr(allpairs, "_COLUMNS", 3)
    rng = random.Random(1)
    sets = lambda n: [None if rng.random() < 0.1 else sorted({int(rng.paretovariate(0.7)) % 90 for _ in range(rng.randint(0, 20))}) for _ in range(n)]
    for _ in range(20):
        a, b = sets(rng.randint(1, 30)), sets(rng.randint(1, 40))
        got = allpairs.shared(*(allpairs.Sets.of(pa.array(x, pa.list_(pa.int64()))) for x in (a, b)))
        assert np.array_equal(got, [[len({*(x or ())} & {*(y or ())}) for y in b] for x in a])


def test_nearest_is_the_cap_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(allpairs, "SIDE", 7)
    monkeypatch.setattr(allpairs, "HELD", 20)
    n = some_notes(spark, 120, random.Random(4))
    want = graph.cap_similarities(graph.same_dir_pairs(n).union(graph.tag_pairs(n)), 5).collect()
    got = graph.nearest(n)
    assert sorted(got.collect()) == sorted(want) and len(want) > 300
    assert graph.nearest(n.limit(0)).collect() == []


def test_degrees_of_a_directory(spark, monkeypatch):
    monkeypatch.setattr(allpairs, "SIDE", 16)
    n = some_notes(spark, 90, random.Random(5))
    pairs = [(r.src, r.token_overlap) for r in graph.same_dir_pairs(n).collect()]
    got = {r.src: r for r in graph.same_dir_degrees(n).collect()}
    assert len(got) == n.count() and {r.class_id for k, r in got.items() if k.startswith("m")} <= {"m000", *(k for k in got if k < "m000")}
    assert {k: (r.n_links, r.token_overlap) for k, r in got.items()} == {k: (sum(a == k for a, _ in pairs), sum(o for a, o in pairs if a == k)) for k in got}


def test_only_rows_without_an_answer_go_on():
    """A text that found a near note is not compared with the next block."""
    schema = pa.schema([("id", pa.int64()), ("g", pa.list_(pa.int64()))])
    block = lambda rows: allpairs.Block(pa.RecordBatch.from_pylist([{"id": i, "g": g} for i, g in enumerate(rows)], schema), ["g"])
    own = block([[1, 2], [3, 4], []])
    fold = allpairs.Reached(own, {"g": lambda x: np.full(x.n, 0.5)})
    fold.add(own, block([[1, 2]]))
    assert fold.open.tolist() == [False, True, True]
    fold.add(own, block([[9]] * 70 + [[3, 4]]))
    assert fold.rows(own).column(1).to_pylist() == [True, True, False]


def test_needles_longer_than_all_texts_take_no_pass(spark, monkeypatch):
    passes = []
    was = substrings.Finder.__init__
    monkeypatch.setattr(substrings.Finder, "__init__", lambda self, needles: (passes.append(needles), was(self, needles))[1])
    n = spark.createDataFrame([(i, f"a name of some length {i}") for i in range(50)], "n int, s string")
    h = spark.createDataFrame([(1, "short"), (2, "")], "h int, t string")
    assert substrings.contained(n, h, 40).collect() == [] and passes == [[]]


def test_link_targets_stand_for_their_pages(spark):
    links = spark.createDataFrame([("p", "ab"), ("q", "ab"), ("q", "none"), ("p", "xabx")], "src string, target string")
    names = spark.createDataFrame([("xabx",), ("AB c",), ("a",), ("",)], "name string")
    pairs, members = graph.partial_targets(links, names)
    assert sorted(map(tuple, pairs.collect())) == [("ab", "AB c"), ("ab", "a"), ("ab", "xabx")] and sorted(map(tuple, members.collect())) == [("ab", "p"), ("ab", "q")]
    assert sorted(map(tuple, graph.partial_links(links, names).collect())) == sorted((s, d) for s in "pq" for d in ("AB c", "a", "xabx"))


def test_edge_degrees_count_new_edges(spark):
    n = some_notes(spark, 60, random.Random(6)).withColumn("summary", F.concat("summary", F.lit(" more")))
    new = n.where("note_ord % 3 = 0").select(F.concat(F.lit("new"), "name").alias("name"), "tags", "summary").unionByName(n.where("name = 'm001'").select("name", "tags", "summary"))
    links = new.select(F.col("name").alias("src"), F.explode(F.array(F.lit("m00"), F.lit("n01"), F.lit("zz"))).alias("target")).where("target <> 'n01' or src > 'newn03'")
    want = {}
    for r in ingest.new_edges(new, links, n).collect():
        w = want.setdefault(r.src, {"pre": 0, "sim": 0, "w": 0})
        w[r.kind] += 1
        w["w"] += int(r.weight * 1e4 + 0.5) if r.kind == "sim" else 0
    got = {r.src: r for r in ingest.edge_degrees(new, links, n).collect()}
    assert len(got) == new.count() and all((r.n_pre, r.n_sim, r.sim_weight) == tuple(want.get(k, {"pre": 0, "sim": 0, "w": 0}).values()) for k, r in got.items())


def test_search_of_many_queries_is_in_bounded_rows(spark):
    """Featured notes and postings give the same; a task sends on k rows a query."""
    n = spark.range(300).select(F.col("id").alias("note_ord"), F.concat(F.lit("note "), F.col("id") % 40).alias("name"), F.lit("graph engine").alias("summary"), F.array(F.lit("t")).alias("tags"))
    q = spark.createDataFrame([(i, f"graph note {i}") for i in range(30)] + [(99, "")], "query_id long, query string")
    rows = lambda index: sorted(map(tuple, search.ngram_search(index, n, q, 3).select("query_id", "rank", "note_ord", "score").collect()))
    assert rows(search.featured(n)) == rows(search.postings(n)) and len(rows(search.featured(n))) == 90
    run = search._scored(np.array([7]), np.array([0, 1]), np.array([0]), np.array([1.5]), 2)
    out = list(run([pa.RecordBatch.from_arrays([pa.array(range(k, k + 50)), pa.array([[0]] * 50, pa.list_(pa.int32()))], names=["note_ord", "has"]) for k in (100, 0)]))
    assert [x.to_pydict() for x in out] == [{"query_id": [7, 7], "note_ord": [0, 1], "score": [1.5, 1.5]}]


def test_dense_scores_are_bounded(monkeypatch):
    monkeypatch.setattr(search, "SCORE_BYTES", 8 * 100 * 10)
    sizes = []
    was = np.partition
    monkeypatch.setattr(search.np, "partition", lambda a, *x, **k: (sizes.append(a.size), was(a, *x, **k))[1])
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([str(i) for i in range(500)]), pa.array(v.tolist())], names=["vec_id", "name", "embedding"])
    out = pa.Table.from_batches(list(search._nearest(np.arange(100), v[:100], 4)([batch]))).to_pydict()
    scores = np.floor(v[:100] @ v.T * 1e4 + 0.5) / 1e4
    assert max(sizes) <= 1000 and [out["vec_id"][4 * q : 4 * q + 4] for q in range(100)] == [np.lexsort((np.arange(500), -scores[q]))[:4].tolist() for q in range(100)]


def test_later_tiers_see_open_queries_alone(spark, monkeypatch):
    asked = []
    was = sessions.contained
    monkeypatch.setattr(sessions, "contained", lambda a, b, *x: (asked.append((a.count(), b.count())), was(a, b, *x))[1])
    n = spark.createDataFrame([(f"some name {i}", i, f"dir/some name {i}.md") for i in range(20)], "name string, note_ord long, path string")
    q = n.select(F.col("name").alias("query")).unionByName(spark.createDataFrame([("me name",), ("some name 3 and more",), ("dir/so",), ("more some and name 4",), ("no",)], "query string"))
    got = sorted(tuple(r) for r in sessions.fuzzy_match(q, n).collect() if r.tier > 1)
    assert got == [("dir/so", "some name 0", 4), ("me name", "some name 0", 2), ("some name 3 and more", "some name 3", 3)] and asked == [(5, 20), (20, 4), (3, 20)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_over_several_blocks_against_loops(monkeypatch, seed):
    """Ties by name over blocks and directories, tokens and tags of any number, and rows without any."""
    monkeypatch.setattr(allpairs._Table, "ROWS", 3)
    monkeypatch.setattr(allpairs._Table, "PAIRS", 7)
    monkeypatch.setattr(allpairs.Nearest, "ROWS", 5)
    monkeypatch.setattr(allpairs.Nearest, "AT_ONCE", 40)
    rng = random.Random(seed)
    some = lambda most, n: sorted({int(rng.paretovariate(0.6)) % n for _ in range(rng.randint(0, most))})
    rows = [{"id": f"n{i:03d}", "within": rng.choice(["d0", "d0", "d1", f"own{i}"]), "tags": some(6, 12), "tokens": some(rng.choice([6, 6, 300]), 400)} for i in range(150)]

    def keys(t):
        size = len(t)
        return sorted({hash((x, min(size, m), max(size, m))) for x in t for m in range(1, 6 - size)} | {hash((x, y)) for x in t for y in t if x < y})

    rows = sorted(({**r, "keys": keys(r["tags"])} for r in rows), key=lambda r: (r["within"], r["id"]))
    kinds = {"tags": pa.list_(pa.int64()), "tokens": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())}
    block = lambda part: allpairs.Block(pa.RecordBatch.from_pylist(part, pa.schema([("id", pa.string()), ("within", pa.string()), *kinds.items()])), list(kinds))

    def near(same, j, o):
        return (same & ((o >= 3) | (j >= 0.35))) | (j >= 0.4) | ((j >= 0.25) & (o >= 5))

    x = block(rows[20:70])
    fold = allpairs.Nearest(x, near, 0.25, 3, 4)
    parts = [block(rows[i : i + 37]) for i in range(0, 150, 37)]
    for y in sorted(parts, key=lambda y: not x.dirs & y.dirs):
        fold.add(x, y)
    for a, got in zip(rows[20:70], fold.best):
        want = []
        for b in rows:
            c, o = len({*a["tags"]} & {*b["tags"]}), len({*a["tokens"]} & {*b["tokens"]})
            j = c / (len(a["tags"]) + len(b["tags"]) - c) if c else 0.0
            if near(a["within"] == b["within"], j, o):
                want.append((-(j * 10 + o * 0.5), b["id"].encode(), j, o))
        assert got == sorted(want)[:4]


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_alone_are_those_of_degrees(seed):
    """Indices at the thresholds, empty sets and rows of one id included; tokens are asked where they decide."""
    rng = random.Random(seed)
    schema = pa.schema([("id", pa.string()), *((f, pa.list_(pa.int64())) for f in ("tags", "tokens", "g"))])
    some = lambda most, n: sorted({rng.randrange(n) for _ in range(rng.randint(0, most))})
    block = lambda n, k: allpairs.Block(pa.RecordBatch.from_pylist([{"id": f"{k}{i % 9}", "tags": some(4, 9), "tokens": some(12, 20), "g": some(23, 60)} for i in range(n)], schema), ["tags", "tokens", "g"])
    near = lambda jac, o, ng: (jac >= 0.4) | ((jac >= 0.25) & (o >= 5)) | (ng >= 0.15)
    x = block(60, "n")
    x.ids = [f"n{i}" for i in range(60)]
    one, other = (kind(x, near, lambda jac, o: np.ones(len(jac)), {"tags": 0.25, "g": 0.15}) for kind in (allpairs.Degrees, allpairs.Near))
    for y in (block(50, "n"), block(70, "m"), block(3, "n")):
        one.add(x, y)
        other.add(x, y)
    assert one.links.tolist() == other.links.tolist() and 100 < one.links.sum() < 60 * 123 and other.rows(x).column(2).null_count == 60


def test_ingest_does_not_weigh(spark, monkeypatch):
    """Edges of new notes are counted alone where only their number is told."""
    monkeypatch.setattr(ingest, "Degrees", None)
    n = some_notes(spark, 30, random.Random(8)).withColumn("tags", F.array(F.lit("decree")))
    t = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "epsilon zeta")], "text_id int, text string")
    kept = [ingest.increment(t, n, [], "f", "s", listed=k)[2] for k in (True, False)]
    assert sorted(map(tuple, kept[0].select("text_id", "edges_added").collect())) == sorted(map(tuple, kept[1].select("text_id", "edges_added").collect()))
