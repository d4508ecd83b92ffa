"""Relations from sessions: texts, mentions, co-occurring pairs, fuzzy names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.text import found
from notegraph.operators.lineage import cut
from notegraph.operators.substrings import contained
from notegraph.settings import NAME_SUFFIXES

WORD = "[\\p{L}\\p{N}_一-鿿]{2,}"


def session_texts(messages: DataFrame) -> DataFrame:
    """messages(session, turn, text) -> session, text in turn order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return messages.groupBy("session").agg(F.array_join(F.transform(turns, lambda m: m["text"]), "\n").alias("text"))


def mentions(texts: DataFrame, words: DataFrame) -> DataFrame:
    """session, name for every name in words(name) that is a word of the session's text."""
    seen = texts.select("session", F.explode(F.array_distinct(found(F.lower("text"), "[\\p{L}\\p{N}_]+"))).alias("name"))
    return seen.join(words.select("name").distinct(), "name", "left_semi").select("session", "name")


def link_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    links = texts.select("session", F.explode(F.array_distinct(found(F.col("text"), "\\[\\[([^\\]|#]+)(?:[#|][^\\]]+)?\\]\\]", 1))).alias("name"))
    return links.join(names.select("name").distinct(), "name", "left_semi").select("session", "name")


def recent(sessions: DataFrame, now: str, days: int) -> DataFrame:
    """sessions(…, created: ISO text) of the last days; those whose time is missing or unreadable stay, and all do for no days."""
    if days <= 0:
        return sessions
    return sessions.where(F.coalesce(F.try_to_timestamp("created") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), F.lit(True)))


def all_mentions(texts: DataFrame, notes: DataFrame, terms: DataFrame, suffixes=NAME_SUFFIXES) -> DataFrame:
    """session, name of every note that a session's text mentions: linked, meant by a term(term) it holds, or by a word shaped like a name.

    Terms and name-shaped words stand for the note that fits them best, by ``fuzzy_match``.
    """
    shaped = "[\\p{L}\\p{N}_一-鿿]{2,30}(?:" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")"
    by_shape = texts.select("session", F.explode(F.array_distinct(found(F.col("text"), shaped))).alias("query"))
    held = contained(terms.select(F.col("term").alias("n"), F.lower("term").alias("s")), texts.select(F.col("session").alias("h"), F.lower("text").alias("t")))
    asked = by_shape.unionByName(held.select(F.col("h").alias("session"), F.col("n").alias("query"))).distinct()
    meant = asked.join(fuzzy_match(asked.select("query").distinct(), notes).select("query", "name"), "query").select("session", "name")
    return link_mentions(texts, notes).unionByName(meant).distinct()


def import_state(first: DataFrame, second: DataFrame, merged: DataFrame, edges: DataFrame, when: str) -> DataFrame:
    """One row about an import: relations of either source, merged ones by type, and the graph's edges after it."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    by_type = merged.agg(F.count("*").alias("merged_relations"), F.count_if(F.col("type") == "prerequisite").alias("prerequisite_added"), F.count_if(F.col("type") == "similarity").alias("similarity_added"))
    total = edges.agg(F.count_if(F.col("kind") == "pre").alias("prerequisite_total"), F.count_if(F.col("kind") == "sim").alias("similarity_total"))
    return n(first, "sdk_relations").crossJoin(n(second, "fallback_relations")).crossJoin(by_type).crossJoin(total).select(F.lit(when).alias("last_import"), "*")


def pairs(mentioned: DataFrame, most: int = 15) -> DataFrame:
    """session, a, b (a < b) within sessions of at most ``most`` notes, numbered by pair_ord."""
    sets = mentioned.groupBy("session").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") <= most)
    one = sets.select("session", "names", F.explode("names").alias("a"))
    both = one.select("session", "a", F.explode(F.filter("names", lambda n: n > F.col("a"))).alias("b"))
    return both.withColumn("pair_ord", F.row_number().over(Window.partitionBy("session").orderBy("a", "b")))


def relations(pair_rows: DataFrame, per_session: int = 20, promote: int = 2) -> DataFrame:
    """Similar for each session's first pairs; prerequisite, too, for pairs of ``promote`` sessions."""
    near = pair_rows.where(F.col("pair_ord") <= per_session).select("a", "b", F.lit("similarity").alias("type"))
    often = pair_rows.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= promote).select("a", "b", F.lit("prerequisite").alias("type"))
    key = [F.lower("a"), F.lower("b"), F.col("type")]
    every = near.union(often).distinct()
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("a", "b"))).where("_r = 1").drop("_r")


def merge_relations(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both relation tables; of triples equal but for case the first table's stands."""
    both = first.withColumn("_p", F.lit(1)).unionByName(second.withColumn("_p", F.lit(2)))
    key = [F.lower("a"), F.lower("b"), F.col("type")]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_p", "a", "b"))).where("_r = 1").select("a", "b", "type")


def fuzzy_match(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """queries(query) -> query, name, tier of the note that fits best.

    Tiers: 1 equal, 2 query in name, 3 name (four characters or more) in query, 4 query in
    path, 5 three or more common words (most first); within a tier the first note.
    """
    q = queries.select("query", F.lower("query").alias("ql")).distinct()
    n = notes.select("name", "note_ord", F.lower("name").alias("nl"), F.lower("path").alias("pl"))
    pick = lambda df, tier, extra=None: df.select("query", "name", "note_ord", F.lit(tier).alias("tier"), (extra if extra is not None else F.lit(0)).alias("neg"))
    key = F.struct("name", "note_ord").alias("h")
    unpack = lambda df, need, hay: df.select(F.col(need).alias("query"), f"{hay}.name", f"{hay}.note_ord")
    every = cut(pick(q.join(n, q["ql"] == n["nl"]), 1))
    # Only what no earlier tier answers is asked of the next.
    left = lambda: cut(q.join(every.select("query"), "query", "left_anti"))
    q = left()
    every = every.unionByName(cut(pick(unpack(contained(q.select(F.col("query").alias("n"), F.col("ql").alias("s")), n.select(key, F.col("nl").alias("t"))), "n", "h"), 2)))
    q = left()
    long = n.where(F.length("nl") >= 4).select(F.struct("name", "note_ord").alias("n"), F.col("nl").alias("s"))
    every = every.unionByName(cut(pick(contained(long, q.select(F.col("query").alias("h"), F.col("ql").alias("t"))).select(F.col("h").alias("query"), "n.name", "n.note_ord"), 3)))
    q = left()
    every = every.unionByName(cut(pick(unpack(contained(q.select(F.col("query").alias("n"), F.col("ql").alias("s")), n.select(key, F.col("pl").alias("t"))), "n", "h"), 4)))
    q = left()
    qw = q.select("query", F.explode(F.array_distinct(found(F.col("ql"), WORD))).alias("w"))
    nw = n.select("name", "note_ord", F.explode(F.array_distinct(found(F.col("nl"), WORD))).alias("w"))
    common = qw.join(nw, "w").groupBy("query", "name", "note_ord").agg(F.count("*").alias("c")).where("c >= 3")
    every = every.unionByName(pick(common, 5, -F.col("c")).withColumn("neg", F.col("neg").cast("int")))
    best = F.row_number().over(Window.partitionBy("query").orderBy("tier", "neg", "note_ord"))
    return every.withColumn("_r", best).where("_r = 1").select("query", "name", "tier")


def match_relations(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """relations(a, b, type) by fuzzy names, without those that end where they start."""
    m = fuzzy_match(rows.select(F.col("a").alias("query")).union(rows.select("b")), notes).select("query", "name")
    a, b = m.select(F.col("query").alias("a"), F.col("name").alias("src")), m.select(F.col("query").alias("b"), F.col("name").alias("dst"))
    return rows.join(a, "a").join(b, "b").where("src <> dst").select("src", "dst", "type").distinct()
