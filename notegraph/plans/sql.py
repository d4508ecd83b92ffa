"""Shared pieces of the DuckDB twins."""

from __future__ import annotations

from notegraph.settings import STOP_WORDS, TOKEN_PATTERN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


STOP = items(STOP_WORDS)


def tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '{TOKEN_PATTERN}')), lambda w: NOT list_contains({STOP}, w))"


def grams(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_distinct([substr({x}, i, {n}) FOR i IN range(1, length({x}) - {n} + 2)]) ELSE [] END"


def char_grams(x: str) -> str:
    return f"list_distinct(list_concat({grams(f'lower({x})', 2)}, {grams(f'lower({x})', 3)}))"


def clean_grams(x: str) -> str:
    return grams(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]', '', 'g')", 2)


def terms(x: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]', ' ', 'g'), ' '), lambda w: length(w) >= 2)"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_concat([w], [substr(w, i, 2) FOR i IN range(1, length(w))]))))"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {inter}::DOUBLE / (len({a}) + len({b}) - {inter}) END"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def digest(x: str) -> str:
    return f"md5(array_to_string(list_sort({x}), '|'))"


def round4(x: str) -> str:
    return f"floor(({x}) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE"


def round3(x: str) -> str:
    return f"floor(({x}) * 1e3::DOUBLE + 0.5::DOUBLE) / 1e3::DOUBLE"


_LINE = "substr(string_split(text, chr(10))[1], 1, 60)"
NOTES = f"""notes AS MATERIALIZED (
  SELECT doc_id AS note_ord, lpad(doc_id::VARCHAR, 6, '0') || '-' || {_LINE} AS name, source AS dir,
    source || '/' || lpad(doc_id::VARCHAR, 6, '0') || '-' || {_LINE} || '.md' AS path,
    list_sort(list_distinct(list_concat(list_sort({tokens(_LINE)})[1:4], CASE WHEN quality = 1 THEN ['decree'] ELSE [] END, CASE WHEN toxic = 1 THEN ['ephemeral'] ELSE [] END))) AS tags,
    substr(text, 1, 500) AS summary, n_chars::INT AS size, text, lang
  FROM documents LEFT JOIN labels USING (doc_id))"""

NOTE_LINKS = """note_links AS (
  SELECT a.name AS src, b.name AS target FROM (SELECT name, note_ord, unnest([note_ord + 1, note_ord // 2]) AS t FROM notes) a JOIN notes b ON b.note_ord = a.t WHERE a.t <> a.note_ord)"""

PAGES = """pages_ AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS name, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS links FROM pages),
page_links AS (SELECT * FROM (SELECT name AS src, unnest(links) AS target FROM pages_) WHERE target <> '')"""

PAGE_EDGES = """page_pairs AS (SELECT links[i] AS src, links[i + 1] AS dst FROM (SELECT links, unnest(range(1, len(links))) AS i FROM pages_)),
page_edges AS (SELECT src, dst, CASE WHEN count(*) % 2 = 1 THEN 'pre' ELSE 'sim' END AS kind, 0.3::DOUBLE + 0.1::DOUBLE * least(count(*), 5) AS w
  FROM page_pairs WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)"""

EVENTS = """edge_events AS (
  SELECT 'u' || user_id AS src, 'k' || json_extract_string(props, '$.k') AS dst,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'consumed' WHEN event_type = 'signup' THEN 'consumed_unsatisfied' WHEN event_type = 'view' THEN 'ignored' ELSE 'legacy' END AS event,
    ts, event_id, epoch_us(ts) / 1e6::DOUBLE AS epoch, value FROM events)"""

WEIGHTS = """event_weights AS (
  SELECT src, dst, 'similarity' AS type, least(floor(max(value)), 39) / 20 + 0.05::DOUBLE AS weight, count(*)::INT AS use_count,
    CASE WHEN count(*) % 3 = 0 THEN 'decree' WHEN count(*) % 3 = 1 THEN 'ephemeral' ELSE 'default' END AS tag, max(epoch) AS last_touch, min(epoch) AS last_updated
  FROM edge_events WHERE event = 'consumed' GROUP BY src, dst)"""

MARKDOWN = r"""markdown AS (
  SELECT doc_id, source || '/n' || doc_id || '.md' AS path,
    concat('---', chr(10), 'tags: [', lang, ', ''', source, ''']', chr(10), 'title: note: ', doc_id, chr(10), 'title: last ', doc_id, chr(10), 'no colon here', chr(10), '---', chr(10), '# Note ', doc_id, chr(10), chr(10), text,
      chr(10), chr(10), '## Links', chr(10), chr(10), 'See [[Home|the start]], [[', lang, '#part]] and [[n', doc_id, ']]. #', lang, ' a#b #', source, ' [site](http://x.org/y)', chr(10), chr(10), '## Again *here*', chr(10), chr(10),
      '```', chr(10), 'code', chr(10), '```', chr(10), text) AS text FROM documents),
body AS (SELECT doc_id, path, text, regexp_replace(text, '(?s)^---\s*\n(.*?)\n---\s*\n', '') AS b FROM markdown)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
