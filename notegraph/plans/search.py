"""Resolve cascade, router, ranked search, unified results, evaluation, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators import evaluate, index, iterate, lineage, resolve, router, search, sqlsearch
from notegraph.plans import base, graph
from notegraph.plans import sql as S
from notegraph.settings import LINE_SOURCE, OTHER_SOURCE_WEIGHT, SKILL_SOURCE, SOURCE_WEIGHTS
from notegraph.sources import tables

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ASK = [(i, w) for i, w in enumerate(base.WORDS) if w]
_ASK_SQL = f"q(query_id, query) AS (VALUES {', '.join(f'({i}, {S.lit(w)})' for i, w in ASK)}), raw AS (SELECT query_id::BIGINT AS query_id, query, lower(query) AS ql, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> '') AS t FROM q)"
_ASKED = base.KEPT_SQL.replace("SELECT query_id, query, CASE", "SELECT query_id, query, ql, CASE")


def asked(spark):
    return search.query_frame(spark, ASK)


# ------------------------------------------------------------- resolve, route

_N = "len(list_filter(terms, lambda t: contains({}, t)))"
_CHUNK = "coalesce(list_max(list_transform(chunks, lambda c: len(list_filter(terms, lambda t: contains(c, t))))), 0)"
SCORED = f"""low AS MATERIALIZED (SELECT name, path, note_ord, lower(name) AS nl, lower(path) AS pl, lower(summary) AS sl, list_transform(tags, lambda x: lower(x)) AS tl,
  [lower(substr(text, i, 2000)) FOR i IN range(1, greatest(length(text), 1) + 1, 2000)] AS chunks FROM notes),
counted AS (SELECT *, len(terms) AS n, {_N.format('nl')} AS in_name, {_N.format('pl')} AS in_path, {_N.format('sl')} AS in_summary,
  len(list_filter(tl, lambda x: len(list_filter(terms, lambda t: contains(x, t))) > 0)) > 0 AS in_tags, {_CHUNK} AS best FROM low, asked),
scored AS MATERIALIZED (SELECT query_id, name, path, note_ord, score FROM (SELECT *, CASE WHEN ql = nl THEN 100 WHEN contains(nl, ql) OR contains(ql, nl) THEN 85 WHEN n > 0 AND in_name = n THEN 80
  WHEN n > 0 AND in_name >= greatest(1, (n + 1) // 2) THEN 66 WHEN n > 0 AND in_name >= 1 THEN 46 WHEN n > 0 AND in_path >= greatest(1, (n + 1) // 2) THEN 50
  WHEN n > 0 AND in_summary >= 1 THEN 40 WHEN n > 0 AND in_tags THEN 30 WHEN n > 0 AND best > 0 THEN least(62, 40 + floor(20 * best / n) + CASE WHEN best >= 2 THEN 5 ELSE 0 END) ELSE 0 END::INT AS score FROM counted) WHERE score > 0)"""
MATCHED = """matched AS MATERIALIZED (SELECT * EXCLUDE top FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_ord) AS match_ord, max(score) OVER (PARTITION BY query_id) AS top FROM scored WHERE score >= 45)
  WHERE match_ord <= CASE WHEN top >= 70 THEN 10 ELSE 20 END)"""


@query(S.with_(S.NOTES, _ASK_SQL, _ASKED, SCORED) + "SELECT query_id, note_ord, score FROM scored")
def resolve_scores(spark, d):
    return resolve.scores(tables.chunked(tables.notes(spark, d)), asked(spark)).select("query_id", "note_ord", "score")


@query(S.with_(S.NOTES, _ASK_SQL, _ASKED, SCORED, MATCHED) + "SELECT query_id, match_ord, name, score FROM matched")
def resolve_nodes(spark, d):
    return resolve.matches(resolve.scores(tables.chunked(tables.notes(spark, d)), asked(spark))).select("query_id", "match_ord", "name", "score")


_COMMON = f"len(t) >= 3 AND len(list_filter(t, lambda x: NOT list_contains({S.items(base.COMMON_QUERY_WORDS)}, x))) = 0"
STATE = f"""state AS MATERIALIZED (SELECT r.query_id, {_COMMON} AS common, n_matches, best, n_matches IS NOT NULL AND (NOT ({_COMMON}) OR best >= 70) AS graph
  FROM raw r LEFT JOIN (SELECT query_id, count(*) AS n_matches, max(score) AS best FROM matched GROUP BY 1) USING (query_id)),
found AS MATERIALIZED (SELECT * FROM matched WHERE query_id IN (SELECT query_id FROM state WHERE graph)),
starts AS MATERIALIZED (SELECT query_id, name, match_ord AS start_ord FROM found WHERE match_ord <= 5)"""
MERGED = f"""sim_all AS (SELECT query_id, name, source_node, weight, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, ord) AS rank FROM (SELECT * FROM hop UNION ALL SELECT * FROM fallback) QUALIFY rank <= 10),
parts AS (SELECT query_id, name, 1 AS part, match_ord AS ord, score::DOUBLE AS match_score, score / 100.0::DOUBLE AS rank_score, NULL::VARCHAR AS edge_from FROM found
  UNION ALL SELECT query_id, name, 2, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, ord), rank_score * 100, rank_score, caller FROM expanded
  UNION ALL SELECT query_id, name, 3, rank, weight * 100, weight, source_node FROM sim_all),
once AS (SELECT p.*, n.path FROM parts p JOIN notes n USING (name) QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY part, ord) = 1),
merged AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, part, ord) AS rank, name, path,
  CASE part WHEN 1 THEN '{router.DIRECT}' WHEN 2 THEN '{router.PRE}' ELSE '{router.SIM}' END AS source, match_score, rank_score, edge_from FROM once QUALIFY rank <= 8)"""
SUMMARY = """summary AS (SELECT query_id, coalesce(CASE WHEN graph THEN n_matches END, 0) AS n_matches, CASE WHEN NOT graph THEN 'none' WHEN n_matches >= 3 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN NOT graph THEN 'none' WHEN common THEN 'graph_common_override' ELSE 'graph' END AS routing FROM state)"""
ROUTED = (*graph.BUILT, graph.TOUCHED, graph.WEIGHED, _ASK_SQL, _ASKED, SCORED, MATCHED, STATE, *graph.expand_sql("starts", "weighed"), graph.similar_sql("starts", "weighed"), graph.FALLBACK, MERGED, SUMMARY)


def routed(spark, d, exact=False):
    n, edges = graph.note_graph(spark, d)
    n, edges = tables.chunked(n), lineage.stored(edges)
    return n, *router.route(n, edges, asked(spark), exact=exact)


def _merged(m):
    return m.select("query_id", "rank", "name", "source", T.round4(F.col("match_score")).alias("match_score"), T.round4(F.col("rank_score")).alias("rank_score"), "edge_from")


_SHOW = f"SELECT query_id, rank, name, source, {S.round4('match_score')} AS match_score, {S.round4('rank_score')} AS rank_score, edge_from FROM "


@query(S.with_(*ROUTED) + _SHOW + "merged")
def router_graph(spark, d):
    return _merged(routed(spark, d)[1])


@query(S.with_(*ROUTED) + "SELECT * FROM summary")
def router_summary(spark, d):
    return routed(spark, d)[2]


_EXACT = (*graph.BUILT, graph.TOUCHED, graph.WEIGHED, _ASK_SQL, _ASKED, SCORED, MATCHED, STATE, *graph.exact_sql("starts", "weighed"), graph.similar_sql("starts", "weighed"), graph.FALLBACK, MERGED)


@query(graph.recursive(S.with_(*_EXACT)) + _SHOW + "merged")
def router_exact(spark, d):
    return _merged(routed(spark, d, exact=True)[1])


def ngram_sql(queries: str, k: int) -> str:
    f = f"SELECT query_id, 'gram' AS kind, unnest({S.char_grams('query')}) AS feature FROM {queries} UNION ALL SELECT query_id, 'term', unnest({S.terms('query')}) FROM {queries}"
    return f"""features AS ({f}), matching AS (SELECT p.note_ord, f.* FROM postings p JOIN features f USING (kind, feature)),
wts AS (SELECT query_id, kind, feature, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) * CASE kind WHEN 'term' THEN 2 ELSE 1 END AS w FROM matching, (SELECT count(*)::DOUBLE AS n FROM notes) GROUP BY query_id, kind, feature, n),
ngram_hits AS MATERIALIZED (SELECT query_id, note_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_ord) AS rank FROM
  (SELECT query_id, note_ord, {S.round4('sum(w)')} AS score FROM matching JOIN wts USING (query_id, kind, feature) GROUP BY query_id, note_ord) QUALIFY rank <= {k})"""


@query(S.with_(S.NOTES, base.INDEX, _ASK_SQL, ngram_sql("q", 10)) + "SELECT query_id::BIGINT AS query_id, rank, note_ord, score FROM ngram_hits")
def ngram_search(spark, d):
    n = tables.notes(spark, d)
    return search.ngram_search(search.featured(n), n, asked(spark)).select("query_id", "rank", "note_ord", "score")


@query(ORACLE["ngram_search"])
def ngram_search_stored(spark, d):
    """The same from a stored index, of which only the asked features are read."""
    held = index.write(tables.notes(spark, d), lineage.new_folder(spark, "index"))
    return index.ngram_search(held, asked(spark))


@query(ORACLE["ngram_search"])
def search_sql(spark, d):
    """The same by a table function of SQL, once a query."""
    sqlsearch.register(spark, index.write(tables.notes(spark, d), lineage.new_folder(spark, "index")))
    found = spark.sql("SELECT a.query_id, s.rank, s.note_ord, s.score FROM {asked} a, LATERAL search(a.query, 10) AS s", asked=asked(spark))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(S.with_(*ROUTED, base.INDEX, f"open_ AS (SELECT query_id, query FROM raw WHERE {_COMMON} AND query_id IN (SELECT query_id FROM summary WHERE routing = 'none'))", ngram_sql("open_", 8)) + "SELECT query_id, rank, name, score AS match_score, floor(score / 100 * 1e4 + 0.5) / 1e4 AS rank_score FROM ngram_hits JOIN notes USING (note_ord)")
def router_fallback(spark, d):
    n, _, summary = routed(spark, d)
    return router.fallback(n, search.featured(n), asked(spark), summary).select("query_id", "rank", "name", "match_score", T.round4(F.col("rank_score")).alias("rank_score"))


@query(
    S.with_(*ROUTED, base.INDEX, ngram_sql("q", 8))
    + f""", new AS (SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS r, n.name FROM ngram_hits h JOIN notes n USING (note_ord)
  WHERE (h.query_id, n.path) NOT IN (SELECT query_id, path FROM merged) QUALIFY r <= 5)
{_SHOW}(SELECT * FROM merged UNION ALL SELECT query_id, coalesce(m.m, 0) + r, name, NULL, '{router.VECTOR}', NULL, NULL, NULL FROM new LEFT JOIN (SELECT query_id, max(rank) AS m FROM merged GROUP BY 1) m USING (query_id)) AS t(query_id, rank, name, path, source, match_score, rank_score, edge_from)"""
)
def router_hybrid(spark, d):
    return _merged(_hybrid(spark, d)[1])


def _hybrid(spark, d):
    n, merged, _ = routed(spark, d)
    hits = search.ngram_search(search.featured(n), n, asked(spark), 8).join(n.select("note_ord", "name", "path"), "note_ord")
    return n, router.hybrid(iterate._cut(merged), hits)


_OPEN = f"open_ AS (SELECT query_id, query FROM raw WHERE {_COMMON} AND query_id IN (SELECT query_id FROM summary WHERE routing = 'none'))"
_SHOWN = """fb AS (SELECT h.query_id, n.path FROM ngram_hits h JOIN notes n USING (note_ord) WHERE h.query_id IN (SELECT query_id FROM open_)),
shown AS (SELECT query_id, path FROM merged UNION ALL SELECT query_id, path FROM fb),
fresh_hits AS (SELECT query_id, least(count(*), 5) AS n FROM ngram_hits JOIN notes n USING (note_ord) WHERE (query_id, n.path) NOT IN (SELECT query_id, path FROM shown) GROUP BY 1)"""


@query(S.with_(*ROUTED, base.INDEX, ngram_sql("q", 8), _OPEN, _SHOWN) + """SELECT s.query_id, CASE WHEN f.n > 0 THEN 'high' WHEN s.query_id IN (SELECT query_id FROM fb) THEN 'medium' ELSE confidence END AS confidence,
  CASE WHEN s.query_id IN (SELECT query_id FROM fb) THEN 'vector_fallback' ELSE routing END AS routing, (SELECT count(*) FROM shown x WHERE x.query_id = s.query_id) + coalesce(f.n, 0) AS merged_total, coalesce(f.n, 0) AS vector_hits
FROM summary s LEFT JOIN fresh_hits f ON f.query_id = s.query_id""")
def hybrid_summary(spark, d):
    """What the hybrid search says of each query: any new vector hit makes it confident."""
    n, merged, summary = routed(spark, d)
    index, merged = search.featured(n), iterate._cut(merged)
    hits = search.ngram_search(index, n, asked(spark), 8).join(n.select("note_ord", "name", "path"), "note_ord")
    return router.hybrid_answer(merged, summary, router.fallback(n, index, asked(spark), summary), hits)[1]


@query(S.with_(*ROUTED) + f"""SELECT query_id, edge_from AS src, name AS dst, CASE WHEN source = '{router.PRE}' THEN 'pre' ELSE 'sim' END AS type, row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3 AS consumed FROM merged WHERE edge_from IS NOT NULL""")
def implicit_feedback(spark, d):
    return router.implicit_feedback(routed(spark, d)[1])


# --------------------------------------------------------------- other engines

_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_VEC = "vec AS (SELECT vec_id, 'n' || (vec_id // 2) AS name, embedding FROM embeddings), vq AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0)"


@query(S.with_(_VEC) + f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, name, score FROM (
  SELECT * FROM (SELECT b.vec_id AS query_id, a.vec_id, a.name, {S.round4(_DOT)} AS score FROM vec a, (SELECT query_id AS vec_id, embedding FROM vq) b QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {S.round4(_DOT)} DESC, a.vec_id) <= 20)
  QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY score DESC, vec_id) = 1) QUALIFY rank <= 10""")
def dense_search(spark, d):
    e = tables.table(spark, d, "embeddings")
    v = e.select("vec_id", F.concat(F.lit("n"), F.floor(F.col("vec_id") / 2).cast("string")).alias("name"), "embedding")
    return search.dense_search(v, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


PATTERN = "(idiot|licen[cs]e)[^a-z]"
LINES = f"""lines AS (SELECT source || '/' || doc_id || '.md' AS path, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
line_hits AS (SELECT path, min(line) AS line, substr(arg_min(l, line), 1, 200) AS snippet, 0.7::DOUBLE AS score FROM lines WHERE regexp_matches(l, '(?i){PATTERN}') GROUP BY path ORDER BY path LIMIT 10)"""


def _files(spark, d):
    return tables.table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


@query(S.with_(LINES) + "SELECT * FROM line_hits")
def line_scan(spark, d):
    return search.line_scan(_files(spark, d), PATTERN)


SKILLS = "skills AS (SELECT item_id AS skill_id, 'skill number ' || item_id AS name, text AS doc FROM benchmark)"
SKILL_ASK = [(0, "the that"), (1, "thand"), (2, "SKILL number 3"), (3, "er of the"), (4, "nothing here"), (5, "ing the")]
_SKILL_SQL = f"sq(query_id, query) AS (VALUES {', '.join(f'({i}, {S.lit(w)})' for i, w in SKILL_ASK)})"


def _skills(spark, d):
    return tables.table(spark, d, "benchmark").select(F.col("item_id").alias("skill_id"), F.concat(F.lit("skill number "), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("doc"))


SKILL_HITS = """sh AS (SELECT query_id::BIGINT AS query_id, skill_id, name AS title, substr(doc, 1, 200) AS snippet, 0.6::DOUBLE AS score FROM skills, sq WHERE contains(lower(doc), lower(query))),
skill_hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, skill_id) AS rank FROM (SELECT * FROM sh UNION ALL SELECT query_id, skill_id, name, substr(name, 1, 200), 0.4 FROM skills, sq
  WHERE contains(lower(name), lower(query)) AND length(name) > 10 AND query_id NOT IN (SELECT query_id FROM sh)) QUALIFY rank <= 10)"""


@query(S.with_(SKILLS, _SKILL_SQL, SKILL_HITS) + "SELECT query_id, rank, skill_id, title, snippet, score FROM skill_hits")
def skill_scan(spark, d):
    return search.skill_scan(_skills(spark, d), search.query_frame(spark, SKILL_ASK)).select("query_id", "rank", "skill_id", "title", "snippet", "score")


@query(S.with_(SKILLS, _SKILL_SQL) + """, w AS (SELECT skill_id, unnest(list_filter(regexp_split_to_array(lower(doc), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM skills),
len_ AS (SELECT skill_id, count(*) AS n FROM w GROUP BY 1), size_ AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM len_),
ask AS (SELECT DISTINCT query_id::BIGINT AS query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM sq),
tf AS (SELECT skill_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM ask) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, skill_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean))) AS s FROM tf JOIN df USING (term) JOIN ask USING (term) JOIN len_ USING (skill_id), size_ GROUP BY ALL)
SELECT query_id, skill_id, floor(s * 100 + 0.5) / 100 AS score, row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 100 + 0.5) / 100 DESC, skill_id) AS rank FROM s WHERE s > 0 QUALIFY rank <= 8""")
def skill_bm25(spark, d):
    return search.bm25(_skills(spark, d), search.query_frame(spark, SKILL_ASK)).select("query_id", "rank", "skill_id", "score")


@query("SELECT 'src7/' || doc_id || '.md' AS path, substr(text, 1, 300) AS text FROM documents WHERE source = 'src7' AND doc_id = 7")
def point_read(spark, d):
    return search.point_read(_files(spark, d), "src7/7.md", 300)


_HITS_SQL = f"""hits AS MATERIALIZED (SELECT query_id, 1 AS engine_ord, rank AS hit_ord, name AS title, path, '{SOURCE_WEIGHTS and list(SOURCE_WEIGHTS)[0]}' AS source, match_score / 100 AS score FROM merged
  UNION ALL SELECT query_id, 2, rank, title, title, '{SKILL_SOURCE}', score FROM skill_hits
  UNION ALL SELECT q, 3, row_number() OVER (ORDER BY path), path, path, '{LINE_SOURCE}', score FROM line_hits, (SELECT unnest([1, 7]) AS q))"""


def _hits(spark, d):
    merged = routed(spark, d)[1]
    a = router.graph_hits(merged).withColumn("engine_ord", F.lit(1)).drop("snippet")
    b = search.skill_scan(_skills(spark, d), search.query_frame(spark, SKILL_ASK)).select("query_id", "title", F.col("title").alias("path"), F.lit(SKILL_SOURCE).alias("source"), "score", F.col("rank").cast("long").alias("hit_ord"), F.lit(2).alias("engine_ord"))
    c = search.line_scan(_files(spark, d), PATTERN).select("path", "score", F.explode(F.array(F.lit(1), F.lit(7))).alias("query_id"))
    from pyspark.sql import Window

    c = c.withColumn("hit_ord", F.row_number().over(Window.partitionBy("query_id").orderBy("path")).cast("long"))
    c = c.select(F.col("query_id").cast("long"), F.col("path").alias("title"), "path", F.lit(LINE_SOURCE).alias("source"), "score", "hit_ord", F.lit(3).alias("engine_ord"))
    return a.unionByName(b).unionByName(c)


_BOOST = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SOURCE_WEIGHTS.items()) + f" ELSE {OTHER_SOURCE_WEIGHT}::DOUBLE END"


@query(S.with_(*ROUTED, SKILLS, _SKILL_SQL, SKILL_HITS, LINES, _HITS_SQL) + f"""SELECT query_id, rank, title, source, {S.round4('rank_score')} AS rank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, engine_ord, hit_ord) AS rank
  FROM (SELECT *, score * {_BOOST} AS rank_score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, lower(path) ORDER BY engine_ord, hit_ord) = 1)) WHERE rank <= 20""")
def unified_merge(spark, d):
    return router.unified(_hits(spark, d)).select("query_id", "rank", "title", "source", T.round4(F.col("rank_score")).alias("rank_score"))


@query(S.with_(*ROUTED, SKILLS, _SKILL_SQL, SKILL_HITS, LINES, _HITS_SQL) + f"SELECT query_id, rank, title, source, {S.round4('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, engine_ord, hit_ord) AS rank FROM hits) WHERE rank <= 20")
def rest_merge(spark, d):
    return router.plain_union(_hits(spark, d)).select("query_id", "rank", "title", "source", T.round4(F.col("score")).alias("score"))


# ------------------------------------------------------------------ evaluation

# A benchmark passage stands for a question, as its first 60 characters would be typed: relevant are the notes that hold
# the whole passage; returned, those of the question's n-gram search.
_BENCH = "bq AS (SELECT item_id AS query_id, substr(text, 1, 60) AS query, text FROM benchmark)"
_RELEVANT = "relevant AS MATERIALIZED (SELECT query_id, note_ord FROM bq JOIN notes ON contains(notes.text, bq.text))"
_METRICS = f"""metrics AS MATERIALIZED (SELECT query_id, tp, first_hit_rank, {S.round3('p')} AS precision, {S.round3('r')} AS recall, {S.round3('2 * p * r / greatest(0.001::DOUBLE, p + r)')} AS f1, {S.round3('coalesce(1.0::DOUBLE / first_hit_rank, 0)')} AS mrr FROM (
  SELECT *, CASE WHEN n_got > 0 THEN tp / least(5, n_got)::DOUBLE ELSE 0.0::DOUBLE END AS p, tp / n_want::DOUBLE AS r FROM (
    SELECT w.query_id, n_want, coalesce(n_got, 0) AS n_got, coalesce(tp, 0) AS tp, first_hit_rank FROM (SELECT query_id, count(*) AS n_want FROM relevant GROUP BY 1) w
    LEFT JOIN (SELECT query_id, count(*) AS n_got FROM ngram_hits GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS tp, min(rank) AS first_hit_rank FROM ngram_hits JOIN relevant USING (query_id, note_ord) GROUP BY 1) USING (query_id))))"""
_EVAL = (S.NOTES, base.INDEX, _BENCH, _RELEVANT, ngram_sql("bq", 5), _METRICS)


def _evaluated(spark, d):
    n = tables.notes(spark, d)
    b = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("query"), "text")
    rel = evaluate.holders(n.select(F.col("note_ord").alias("name"), F.col("text").alias("t")), b.select("query_id", "text"))
    got = search.ngram_search(search.featured(n), n, b.select("query_id", "query"), 5).select("query_id", "rank", F.col("note_ord").alias("name"))
    return evaluate.metrics(got, rel)


@query(S.with_(*_EVAL) + "SELECT * FROM metrics")
def eval_metrics(spark, d):
    return _evaluated(spark, d)


_AVG = f"count(*) AS n, {S.round3('avg(precision)')} AS mean_precision, {S.round3('avg(recall)')} AS mean_recall, {S.round3('avg(f1)')} AS mean_f1, {S.round3('avg(mrr)')} AS mean_mrr, count(*) FILTER (tp > 0) AS hits, count(*) FILTER (recall = 0) AS zero_recall"


@query(S.with_(*_EVAL) + f"SELECT CASE query_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'broad' ELSE 'body' END AS type, {_AVG} FROM metrics GROUP BY 1")
def eval_by_type(spark, d):
    kind = F.when(F.col("query_id") % 3 == 0, "exact").when(F.col("query_id") % 3 == 1, "broad").otherwise("body")
    return evaluate.averages(_evaluated(spark, d).withColumn("type", kind), "type")


def _averages_sql(mode: str, hits: str) -> str:
    return f"""SELECT '{mode}' AS mode, {_AVG} FROM (SELECT query_id, tp, {S.round3('p')} AS precision, {S.round3('r')} AS recall, {S.round3('2 * p * r / greatest(0.001::DOUBLE, p + r)')} AS f1, {S.round3('coalesce(1.0::DOUBLE / first_hit_rank, 0)')} AS mrr FROM (
  SELECT *, CASE WHEN n_got > 0 THEN tp / least(5, n_got)::DOUBLE ELSE 0.0::DOUBLE END AS p, tp / n_want::DOUBLE AS r FROM (
    SELECT w.query_id, n_want, coalesce(n_got, 0) AS n_got, coalesce(tp, 0) AS tp, first_hit_rank FROM (SELECT query_id, count(*) AS n_want FROM wanted GROUP BY 1) w
    LEFT JOIN (SELECT query_id, count(*) AS n_got FROM {hits} WHERE rank <= 5 GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT h.query_id, count(DISTINCT name) AS tp, min(rank) AS first_hit_rank FROM {hits} h JOIN wanted USING (query_id, name) WHERE rank <= 5 GROUP BY 1) USING (query_id))))"""


_HYBRID_ROWS = """new_rows AS (SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS r, n.name FROM ngram_hits h JOIN notes n USING (note_ord)
  WHERE (h.query_id, n.path) NOT IN (SELECT query_id, path FROM merged) QUALIFY r <= 5),
hybrid_rows AS (SELECT query_id, rank, name FROM merged UNION ALL SELECT query_id, coalesce(m.m, 0) + r, name FROM new_rows LEFT JOIN (SELECT query_id, max(rank) AS m FROM merged GROUP BY 1) m USING (query_id)),
wanted AS (SELECT query_id, name FROM raw JOIN notes ON query <> '' AND contains(lower(text), lower(query)))"""


@query(S.with_(*ROUTED, base.INDEX, ngram_sql("q", 8), _HYBRID_ROWS) + _averages_sql("Graph-only", "merged") + " UNION ALL " + _averages_sql("Hybrid", "hybrid_rows"))
def eval_compare(spark, d):
    """The graph's answers against the hybrid's: relevant are the notes that hold the query."""
    n, merged, _ = routed(spark, d)
    merged = iterate._cut(merged)
    hits = search.ngram_search(search.featured(n), n, asked(spark), 8).join(n.select("note_ord", "name", "path"), "note_ord")
    wanted = n.crossJoin(asked(spark)).where(F.contains(F.lower("text"), F.lower("query"))).select("query_id", "name")
    return evaluate.compare({"Graph-only": merged, "Hybrid": router.hybrid(merged, hits)}, iterate._cut(wanted))


# --------------------------------------------------------------------- fusion

_FUSE = (*graph.ACTIVATION, "sem AS (SELECT query_id, name, score - 0.2::DOUBLE AS sem FROM anchors)", f"act AS (SELECT query_id, name, {S.round4('a')} AS act FROM a3 WHERE a > 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {S.round4('a')} DESC, name) <= 10)",
    *graph.PAGERANK, "pr_ AS (SELECT name, pagerank AS pr FROM ranked_)", "qs AS (SELECT query_id FROM sem UNION SELECT query_id FROM act)",
    "both_scores AS MATERIALIZED (SELECT query_id, name, coalesce(sem, 0) AS sem, coalesce(act, 0) AS act, coalesce(pr, 0) AS pr FROM sem FULL JOIN act USING (query_id, name) FULL JOIN (SELECT * FROM pr_, qs) USING (query_id, name))")


def _scores(spark, d, tenths=False):
    anchors, edges = graph._anchors(spark, d)
    sem = anchors.select("query_id", "name", (F.col("score") - 0.2).alias("score"))
    return iterate.joined_scores(sem, iterate.activate(anchors, edges), iterate.pagerank(edges), tenths=tenths), sem


@query(S.with_(*_FUSE) + f"""SELECT query_id, rank, name, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM (SELECT query_id, name, {S.round4('0.4::DOUBLE * sem + 0.4::DOUBLE * act + 0.2::DOUBLE * pr')} AS score FROM both_scores WHERE 0.4 * sem + 0.4 * act + 0.2 * pr > 0)) WHERE rank <= 10""")
def fusion(spark, d):
    return iterate.fuse(_scores(spark, d)[0]).select("query_id", "rank", "name", "score")


@query(S.with_(*_FUSE) + f"""SELECT f.*, 'p-' || s.name AS payload FROM (SELECT query_id, rank, name, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM (SELECT query_id, name, {S.round4('0.4::DOUBLE * sem + 0.4::DOUBLE * act + 0.2::DOUBLE * pr')} AS score FROM both_scores WHERE 0.4 * sem + 0.4 * act + 0.2 * pr > 0)) WHERE rank <= 10) f
LEFT JOIN sem s ON s.query_id = f.query_id AND s.name = f.name""")
def fusion_structured(spark, d):
    """Fusion of the engines' own outputs; what came from the vector engine carries its payload."""
    anchors, edges = graph._anchors(spark, d)
    hits = anchors.select("query_id", F.col("name").alias("id"), (F.col("score") - 0.2).alias("score"), F.concat(F.lit("p-"), "name").alias("payload"))
    return iterate.fuse_structured(hits, iterate.activate(anchors, edges), iterate.pagerank(edges)).select("query_id", "rank", "name", "score", "payload")


@query(S.with_(*_FUSE) + f""", mixes AS (SELECT a, b, 10 - a - b AS c FROM range(0, 11) x(a), range(0, 11) y(b) WHERE a + b <= 10),
mixed AS (SELECT a, b, query_id, name, {S.round4('raw')} AS score FROM (SELECT a, b, query_id, name, (a * sem + b * act + c * pr) / 10 AS raw FROM both_scores, mixes) WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY a, b, query_id ORDER BY {S.round4('raw')} DESC, name) <= 10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, query_id ORDER BY score DESC, name) AS rank FROM mixed),
rel AS (SELECT query_id, name FROM sem WHERE ascii(name) % 2 = 0),
rr AS (SELECT a, b, query_id, 1.0::DOUBLE / min(rank) AS rr FROM ranked JOIN rel USING (query_id, name) GROUP BY ALL)
SELECT m.a / 10::DOUBLE AS l1, m.b / 10::DOUBLE AS l2, m.c / 10::DOUBLE AS l3, {S.round4('coalesce(s, 0) / (SELECT count(DISTINCT query_id) FROM rel)')} AS mrr FROM mixes m LEFT JOIN (SELECT a, b, sum(rr) AS s FROM rr GROUP BY ALL) USING (a, b)""")
def fusion_grid(spark, d):
    scores, sem = _scores(spark, d, tenths=True)
    return iterate.grid(iterate._cut(scores), sem.where(F.ascii("name") % 2 == 0).select("query_id", "name"))
