"""Facts about single operators: extraction, decay, feedback, walks, readers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from notegraph.functions import decay, text
from notegraph.operators import evaluate, expand, extract, feedback, graph, iterate, resolve, router, search, sessions
from notegraph.settings import COMMON_QUERY_WORDS, DAY, DEFAULT
from notegraph.sources import readers

NOW = DEFAULT.now


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def chunks(spark, body, **options):
    return one(spark, extract.chunks(F.col("v"), **options), body)


SECTION = "检索增强生成 works by finding passages first and writing afterwards. " * 5


def test_chunks_follow_sections(spark):
    got = chunks(spark, f"## One\n{SECTION}\n## Two\n{SECTION}\n## Three\n{SECTION}")
    assert [c.heading for c in got] == ["One", "Two", "Three"] and all("passages" in c.text for c in got)


def test_chunks_drop_fences_and_short_sections(spark):
    got = chunks(spark, f"## Code\n{SECTION}\n```\nprint(1)\n```\n## Short\nabc")
    assert len(got) == 1 and "print" not in got[0].text
    assert chunks(spark, "## Short\nabc") == [] and chunks(spark, "") == []


def test_long_sections_are_cut(spark):
    got = chunks(spark, "## Long\n" + "0123456789" * 300)
    assert [len(c.text) for c in got] == [2000, 1000]


def test_frontmatter_keeps_the_last_of_a_key(spark):
    got = one(spark, extract.frontmatter(F.col("v")), "---\na: 1\nurl: http://x\na: '2'\nno colon\n---\nbody")
    assert got == {"a": "2", "url": "http://x"}
    assert one(spark, extract.frontmatter(F.col("v")), "no block") == {}


def test_links_tags_headings_summary(spark):
    body = "# Top\n\nFirst para.\n\nSee [[A|alias]] and [[B#part]] and [[C]] #tag x#no #标签/sub\n\n##### deep"
    assert one(spark, extract.wikilinks(F.col("v")), body) == ["A", "B", "C"]
    assert one(spark, extract.inline_tags(F.col("v")), body) == ["tag", "标签/sub"]
    assert one(spark, extract.headings(F.col("v")), body) == ["Top"]
    assert one(spark, extract.summary(F.col("v")), body) == "First para."


def test_markdown_folder(spark, tmp_path):
    for path in ("a/one.md", "b/two.md", ".trash/gone.md", "b/skip.txt"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("---\ntags: [x, decree]\n---\n# H\r\n\r\nText [[one]] #y\n")
    notes = {r["path"]: r for r in extract.extract_notes(readers.read_notes(spark, str(tmp_path))).collect()}
    assert set(notes) == {"a/one.md", "b/two.md"}
    n = notes["b/two.md"]
    assert (n["name"], n["dir"], n["tags"], n["wikilinks"], n["summary"]) == ("two", "b", ["decree", "x", "y"], ["one"], "Text [[one]] #y")
    assert {r["path"] for r in readers.list_notes(spark, str(tmp_path)).collect()} == set(notes)


def test_grams_and_terms(spark):
    assert one(spark, text.grams(F.col("v"), 2), "aab a") == ["aa", "ab", "b ", " a"]
    assert one(spark, text.grams(F.col("v"), 2), "a") == [] and one(spark, text.terms(F.col("v")), "") == []
    assert sorted(one(spark, text.terms(F.col("v")), "AI-tool 图谱")) == sorted(["ai", "tool", "to", "oo", "ol", "图谱"])


@pytest.mark.parametrize(
    ("query", "common"),
    [(" ".join(COMMON_QUERY_WORDS[:3]), True), ("AI 视频 工具 产品", True), ("AI 视频", False), ("架构 框架 rag", False), ("", False), ("hello world again", False)],
)
def test_common_gate(spark, query, common):
    assert one(spark, text.all_common(F.col("v")), query) is common


@pytest.mark.parametrize(
    ("tag", "days", "want"),
    [("ephemeral", 2, 0.25), ("ephemeral", 5, 0.03125), ("default", 10, 0.7937), ("decree", 100, 1.0), ("default", None, 1.0), ("default", -3, 1.0), ("unheard of", 30, 0.5)],
)
def test_decay(spark, tag, days, want):
    touch = None if days is None else NOW - days * DAY
    row = spark.createDataFrame([(1.0, tag, touch)], "w double, tag string, t double")
    got = row.select(decay.effective(F.col("w"), F.col("tag"), F.col("t")).alias("x"), decay.may_be_alive(F.col("tag"), F.col("t"), 2.0).alias("m")).first()
    assert got["x"] == pytest.approx(want, abs=1e-3)
    assert got["m"] or got["x"] < DEFAULT.dead_below


def test_bound_never_loses_a_live_edge(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0, 2), rng.choice(["ephemeral", "default", "decree"]), NOW - rng.uniform(0, 400) * DAY) for _ in range(500)]
    df = spark.createDataFrame(rows, "w double, tag string, t double")
    lost = df.where(decay.alive(decay.effective(F.col("w"), F.col("tag"), F.col("t")))).where(~decay.may_be_alive(F.col("tag"), F.col("t"), 2.0))
    assert lost.count() == 0


EDGE = {"from": "a", "to": "b", "type": "pre"}


def deltas(spark, **record):
    base = {"session_id": "s", "ts": "2024-01-01T00:00:00Z", "query": "q", "satisfied": True, "consumed_edges": [], "ignored_edges": [], "edges_used": []} | record
    df = spark.read.schema(readers.FEEDBACK).json(spark.sparkContext.parallelize([json.dumps(base)]))
    return {(r.src, r.dst): (r.delta, r.use_count_delta, r.source) for r in feedback.deltas(feedback.edge_events(df)).collect()}


def test_feedback_deltas(spark):
    assert deltas(spark, consumed_edges=[EDGE]) == {("a", "b"): (0.05, 1, "consumed")}
    assert deltas(spark, ignored_edges=[EDGE]) == {("a", "b"): (-0.02, 0, "ignored")}
    assert deltas(spark, consumed_edges=[EDGE], satisfied=False) == {("a", "b"): (-0.01, 1, "consumed_unsatisfied")}
    assert deltas(spark, edges_used=[EDGE, {"from": "", "to": "b", "type": "pre"}]) == {("a", "b"): (0.05, 1, "consumed_legacy")}


W = "src string, dst string, type string, weight double, use_count int, last_updated double, last_touch double"


@pytest.mark.parametrize(("old", "delta", "want", "change"), [(None, 0.1, 0.6, "created"), (1.99, 0.1, 2.0, "capped_max"), (0.06, -0.1, 0.05, "capped_min"), (1.0, 0.05, 1.05, "updated")])
def test_apply(spark, old, delta, want, change):
    weights = spark.createDataFrame([] if old is None else [("a", "b", "pre", old, 1, NOW, NOW)], W)
    d = spark.createDataFrame([("a", "b", delta, 1, "consumed")], "src string, dst string, delta double, use_count_delta int, source string")
    r = feedback.apply_deltas(weights, d).first()
    assert (r["weight"], r["change"], r["last_touch"]) == (want, change, NOW)


def test_cold_decay(spark):
    rows = [("a", "b", "pre", 1.0, 0, NOW - 60 * DAY, NOW), ("c", "d", "pre", 1.0, 0, NOW - DAY, NOW), ("e", "f", "pre", 1.0, 0, None, NOW)]
    got = {r["src"]: (r["weight"], r["last_updated"]) for r in feedback.cold_decay(spark.createDataFrame(rows, W)).collect()}
    assert got["a"][0] == 0.95 and got["c"][0] == 1.0 and got["e"] == (1.0, NOW)


def test_feedback_log(spark, tmp_path):
    good = {"session_id": "s", "timestamp": "2024-01-31T08:00:00", "query": "q", "satisfied": True, "consumed_edges": [EDGE]}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(good | {"timestamp": "never"}), json.dumps(good | {"timestamp": "2023-01-01T00:00:00Z"})]))
    log = readers.read_feedback(spark, str(tmp_path))
    assert log.count() == 2
    assert readers.feedback_window(log, "2024-02-01 00:00:00").select(F.date_format("ts", "HH:mm").alias("t")).first()["t"] == "00:00"


def recursive(starts, out, limit=3):
    visited, rows = set(), []

    def go(n, depth, caller, w):
        if depth > limit or n in visited:
            return
        visited.add(n)
        for d, x in out.get(n, []):
            go(d, depth + 1, n, x)
        if caller is None or w >= DEFAULT.dead_below:
            rows.append((n, depth, caller))

    for s in starts:
        go(s, 0, None, 0.5)
    return rows


def test_exact_expansion_is_a_depth_first_walk(spark):
    """Many random graphs at once, cycles, loops, repeated starts and dead edges included: names are by graph, ids too."""
    rng = random.Random(4)
    starts, edges, want = [], [], {}
    for q in range(120):
        names = [f"{q}{c}" for c in "abcdefgh"[: rng.randint(1, 8)]]
        out = {n: [(rng.choice(names), rng.choice([0.01, 1.0])) for _ in range(rng.randint(0, 3))] for n in names}
        first = [rng.choice(names) for _ in range(rng.randint(1, 3))]
        starts += [(q, n, i) for i, n in enumerate(first)]
        edges += [(n, d, "pre", i, w) for n, to in out.items() for i, (d, w) in enumerate(to)]
        want[q] = recursive(first, out)
    got = {}
    found = expand.expand_prerequisites_exact(spark.createDataFrame(starts, "query_id long, name string, start_ord int"), spark.createDataFrame(edges, "src string, dst string, kind string, edge_ord int, w double"))
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()
    for r in found.orderBy("query_id", "ord").collect():
        got.setdefault(r.query_id, []).append((r.name, r.depth, r.caller))
    assert got == want


def test_depth_first_and_level_order_differ(spark):
    edges = [("A", "B", 1), ("A", "D", 2), ("B", "C", 1), ("C", "D", 1), ("D", "E", 1)]
    e = spark.createDataFrame([(s, d, "pre", o, 1.0) for s, d, o in edges], "src string, dst string, kind string, edge_ord int, w double")
    starts = spark.createDataFrame([(0, "A", 1)], "query_id long, name string, start_ord int")
    exact = {r["name"]: r["depth"] for r in expand.expand_prerequisites_exact(starts, e).collect()}
    level = {r["name"]: r["depth"] for r in expand.expand_prerequisites(starts, e).collect()}
    assert exact == {"A": 0, "B": 1, "C": 2, "D": 3} and level == {"A": 0, "B": 1, "C": 2, "D": 1, "E": 2}


def test_dead_edges_hide_notes(spark):
    w = spark.createDataFrame([("A", "B", 1.0, "ephemeral", NOW - 5 * DAY), ("A", "C", 1.0, "decree", NOW - 100 * DAY)], "src string, dst string, weight double, tag string, last_touch double")
    e = spark.createDataFrame([(s, d, k, o) for k in ("pre", "sim") for s, d, o in (("A", "B", 1), ("A", "C", 2))], "src string, dst string, kind string, edge_ord int")
    weighed = expand.weigh(e, w)
    starts = spark.createDataFrame([(0, "A", 1)], "query_id long, name string, start_ord int")
    assert {r["name"] for r in expand.expand_prerequisites(starts, weighed).collect()} == {"A", "C"}
    assert {r["name"] for r in expand.expand_similar(starts, weighed).collect()} == {"C"}


NOTES = [("RAG架构分析", "tech/RAG架构分析.md"), ("market notes weekly", "biz/market notes weekly.md"), ("abc", "x/abc.md"), ("RAG", "tech/RAG.md"), ("deep graph engine manual", "tech/manual.md")]


@pytest.mark.parametrize(
    ("query", "want"),
    [("rag", ("RAG", 1)), ("架构分析", ("RAG架构分析", 2)), ("see market notes weekly today", ("market notes weekly", 3)), ("tech/manual", ("deep graph engine manual", 4)),
     ("manual of graph and deep things", ("deep graph engine manual", 5)), ("zzz", None), ("xyz abc xyz", None)],
)
def test_fuzzy_tiers(spark, query, want):
    notes = spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(NOTES)], "name string, path string, note_ord long")
    got = sessions.fuzzy_match(spark.createDataFrame([(query,)], "query string"), notes).collect()
    assert ([(r["name"], r["tier"]) for r in got] or [None])[0] == want


def test_contained_loses_no_pair(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    a, b = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "n long, s string"), spark.createDataFrame([(i, w) for i, w in enumerate(words)], "h long, t string")
    got = {(r["n"], r["h"]) for r in graph.contained(a, b).collect()}
    assert got == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if x in y}


def test_graph_has_no_repeats_or_loops(spark):
    rows = [(i, f"n{i}", "d", ["t", f"u{i % 2}"], "shared words appear here") for i in range(8)]
    notes = spark.createDataFrame(rows, "note_ord long, name string, dir string, tags array<string>, summary string")
    edges, weights = graph.build(notes, spark.createDataFrame([("n1", "n2"), ("n1", "N3"), ("n1", "none")], "src string, target string"))
    got = [(r["src"], r["dst"], r["kind"]) for r in edges.collect()]
    assert len(got) == len(set(got)) and not [g for g in got if g[2] == "sim" and g[0] == g[1]]
    assert {("n1", "n2", "pre"), ("n1", "n3", "pre")} <= set(got)
    assert weights.groupBy("src", "dst").count().where("count > 1").count() == 0


def test_pagerank_mass(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    rank = {r["name"]: r["pagerank"] for r in iterate.pagerank(e).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-4) and rank["a"] == max(rank.values())


def test_the_registered_pagerank_converges(spark):
    import numpy as np

    from notegraph import catalog
    from notegraph.sources import tables

    d = "/root/testdata/sf0.001"
    got = {r["name"]: r["pagerank"] for r in catalog.queries()["pagerank"](spark, d).collect()}
    edges = {(r["src"], r["dst"]) for r in tables.page_edges(tables.pages(spark, d)).select("src", "dst").collect()}
    names = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(names)}
    adj = np.zeros((len(names), len(names)))
    for a, b in edges:
        adj[at[a], at[b]] = adj[at[b], at[a]] = 1
    step = adj / np.maximum(adj.sum(0), 1)
    pr, rounds = np.full(len(names), 1 / len(names)), 0
    while True:
        new = 0.15 / len(names) + 0.85 * (step @ pr)
        if np.abs(new - pr).sum() < 1e-6:
            break
        pr, rounds = new, rounds + 1
    assert rounds > 7 and set(got) == set(names)
    assert all(abs(got[x] - p) < 1.1e-6 for x, p in zip(names, pr))


def test_vector_hits_come_last_without_score(spark):
    merged = spark.createDataFrame([(0, 1, "a", "p/a", "Direct match", 85.0, 0.85, None)], "query_id long, rank int, name string, path string, source string, match_score double, rank_score double, edge_from string")
    hits = spark.createDataFrame([(0, 1, "a", "p/a"), (0, 2, "b", "p/b")], "query_id long, rank int, name string, path string")
    assert [(r["name"], r["rank"], r["rank_score"]) for r in router.hybrid(merged, hits).orderBy("rank").collect()] == [("a", 1, 0.85), ("b", 2, None)]


def test_cascade_scores(spark):
    notes = spark.createDataFrame(
        [(0, "alpha beta", "d/alpha beta.md", "sum", ["tagged"], []), (1, "other", "d/other.md", "alpha inside", [], []), (2, "third", "gamma/third.md", "", [], ["the delta body", "delta epsilon"])],
        "note_ord long, name string, path string, summary string, tags array<string>, chunks array<string>",
    )
    ask = [(0, "alpha beta"), (1, "beta"), (2, "beta alpha"), (3, "beta zeta"), (4, "alpha"), (5, "tagged zz"), (6, "delta epsilon"), (7, "gamma zz")]
    got = {(r["query_id"], r["note_ord"]): r["score"] for r in resolve.scores(notes, search.query_frame(spark, ask)).collect()}
    assert got == {(0, 0): 100, (0, 1): 40, (1, 0): 85, (2, 0): 80, (2, 1): 40, (3, 0): 66, (4, 0): 85, (4, 1): 40, (5, 0): 30, (6, 2): 62, (7, 2): 50}


def test_metrics(spark):
    got = spark.createDataFrame([(0, 1, "x"), (0, 2, "a"), (0, 3, "b")], "query_id long, rank int, name string")
    want = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "z")], "query_id long, name string")
    r = {x["query_id"]: x for x in evaluate.metrics(got, want).collect()}
    assert (r[0]["precision"], r[0]["recall"], r[0]["mrr"], r[0]["first_hit_rank"]) == (0.667, 0.667, 0.5, 2)
    assert (r[1]["precision"], r[1]["recall"], r[1]["mrr"]) == (0.0, 0.0, 0.0)


def test_paths_outside_are_refused(spark):
    notes = spark.createDataFrame([("a/b.md", "text")], "path string, text string")
    assert search.point_read(notes, "a/./b.md", 2).first()["text"] == "te"
    for bad in ("../x", "/etc/passwd", "a/../../b"):
        with pytest.raises(ValueError):
            search.point_read(notes, bad)
