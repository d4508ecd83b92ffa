"""Test tables as notes, links, sessions, feedback and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.text import found, strings, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as notes: the first line names a note and gives its tags. What is taken of a text is taken before labels are joined, so that whole texts are shuffled for those alone who ask for them."""
    line, none = F.substring(F.substring_index("text", "\n", 1), 1, 60), strings([])
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("note_ord"), F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("-"), line).alias("name"), F.slice(F.array_sort(tokens(line)), 1, 4).alias("words"),
        F.col("source").alias("dir"), F.substring("text", 1, 500).alias("summary"), F.col("n_chars").cast("int").alias("size"), "text", "lang",
    )
    marks = F.concat(F.when(F.col("quality") == 1, strings(["decree"])).otherwise(none), F.when(F.col("toxic") == 1, strings(["ephemeral"])).otherwise(none))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "note_ord")
    return d.join(labels, "note_ord", "left").select(
        "note_ord", "name", "dir", F.concat("dir", F.lit("/"), "name", F.lit(".md")).alias("path"),
        F.array_sort(F.array_distinct(F.concat("words", F.coalesce(marks, none)))).alias("tags"), "summary", "size", "text", "lang",
    )


def chunked(n: DataFrame) -> DataFrame:
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(2000))
    return n.withColumn("chunks", F.transform(starts, lambda i: F.substring("text", i, F.lit(2000))))


def note_links(n: DataFrame) -> DataFrame:
    """Links of notes: each to the next and to the one of half its number."""
    link = n.select(F.col("name").alias("src"), F.col("note_ord"), F.explode(F.array(F.col("note_ord") + 1, F.floor(F.col("note_ord") / 2))).alias("to"))
    names = n.select(F.col("note_ord").alias("to"), F.col("name").alias("target"))
    return link.where("to <> note_ord").join(names, "to").select("src", "target")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, name (title), links (paths of its references)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("name"), found(F.col("html"), 'href="/([^"]*)"', 1).alias("links"))


def page_links(p: DataFrame) -> DataFrame:
    return p.select(F.col("name").alias("src"), F.explode("links").alias("target")).where("target <> ''")


def page_edges(p: DataFrame) -> DataFrame:
    """A graph over link words: a page's words in order are similar, each the prerequisite of the next."""
    one = p.select(F.explode(F.filter(F.transform("links", lambda x, i: F.struct(x.alias("src"), F.get("links", i + 1).alias("dst"))), lambda e: e["dst"].isNotNull())).alias("e"), "page_id")
    pairs = one.select("e.src", "e.dst", "page_id").where("src <> '' and dst <> '' and src <> dst")
    kind = F.when(F.col("n") % 2 == 1, "pre").otherwise("sim")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n")).select("src", "dst", kind.alias("kind"), (0.3 + 0.1 * F.least("n", F.lit(5))).alias("w"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "text")


def edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as feedback on the edge from a user to a key."""
    kind = (
        F.when(F.col("event_type").isin("purchase", "click"), "consumed").when(F.col("event_type") == "signup", "consumed_unsatisfied")
        .when(F.col("event_type") == "view", "ignored").otherwise("legacy")
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("dst"), kind.alias("event"),
        F.struct("ts", "event_id").alias("ord"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6).alias("epoch"), "value", "event_id",
    )


def event_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight for every edge that was clicked: by its mean value, touched by its last event."""
    e = edge_events(spark, sf_dir).where("event = 'consumed'")
    tag = F.when(F.count("*") % 3 == 0, "decree").when(F.count("*") % 3 == 1, "ephemeral").otherwise("default")
    return e.groupBy("src", "dst").agg(
        F.lit("similarity").alias("type"), (F.least(F.floor(F.max("value")), F.lit(39)) / 20 + 0.05).alias("weight"), F.count("*").cast("int").alias("use_count"), tag.alias("tag"),
        F.max("epoch").alias("last_touch"), F.min("epoch").alias("last_updated"),
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as Markdown files: doc_id, path, text."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("---\ntags: ["), "lang", F.lit(", '"), "source", F.lit("']\ntitle: note: "), i, F.lit("\ntitle: last "), i, F.lit("\nno colon here\n---\n# Note "), i, F.lit("\n\n"), "text",
        F.lit("\n\n## Links\n\nSee [[Home|the start]], [["), "lang", F.lit("#part]] and [[n"), i, F.lit("]]. #"), "lang", F.lit(" a#b #"), "source", F.lit(" [site](http://x.org/y)\n\n## Again *here*\n\n```\ncode\n```\n"), "text",
    )
    return d.select("doc_id", F.concat("source", F.lit("/n"), i, F.lit(".md")).alias("path"), text.alias("text"))
