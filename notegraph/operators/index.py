"""A stored inverted index: posting blocks by feature, read by the asked features alone, with an early stop.

Postings lie in blocks of at most ``BLOCK`` note numbers each, so that a feature of all notes is many rows (of a block one or
more): kind, feature, block, and within it the sorted places of its notes as short numbers, in compressed Parquet files
that are dealt by range and sorted by feature. A search asks for its features by name, which
the files' statistics answer page by page; beside them lies each feature's number of notes.

As a feature adds the same to every note it is in, its weight is the bound of what it can add.
Of each query the heaviest features come first: the k-th best sum over some of them is a floor; a note that
lies only in features whose weights together stay below the floor cannot be among the best, so these
features make no candidates, and of their blocks only those are opened that hold a candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.functions.text import idf, round4
from notegraph.operators import inverted, search
from notegraph.operators.lineage import cut, stored

BLOCK = 1 << 14
#: Postings of a query that set the floor, about.
LEAD = 2000
_MARGIN = 1e-3


@dataclass
class StoredIndex:
    spark: SparkSession
    root: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/blocks")

    @property
    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/features")

    @property
    def n_notes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/notes")


def write(notes: DataFrame, root: str) -> StoredIndex:
    """The index of notes(note_ord, name, summary, tags, …) in the folder ``root``."""
    # made once: a sort by range would make them again for its sample
    blocks = stored(inverted.blocks(notes, search.indexed_text(notes), BLOCK))
    order = ["feature", "kind", "block"]
    files = lambda df, name: df.repartitionByRange(*[c for c in order if c in df.columns]).sortWithinPartitions(*[c for c in order if c in df.columns]).write.option("compression", "zstd").parquet(f"{root}/{name}")
    files(blocks, "blocks")
    index = StoredIndex(notes.sparkSession, root)
    files(index.blocks.groupBy("kind", "feature").agg(F.sum(F.size("places")).alias("df")), "features")
    notes.agg(F.count("*").alias("n")).write.parquet(f"{root}/notes")
    return index


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows of some features; the names go to the scan."""
    return df.where(F.col("feature").isin(*names)) if names else df.limit(0)


def ngram_search(index: StoredIndex, queries: DataFrame, k: int = 10, lead: int = LEAD) -> DataFrame:
    """As ``search.ngram_search``: query_id, rank, note_ord, score."""
    asked = cut(search.stated(queries).select("query_id", F.explode(search._features("query")).alias("f")).select("query_id", "f.kind", "f.feature"))
    names = [r[0] for r in asked.select("feature").distinct().collect()]  # of at most QUERIES_AT_MOST queries
    stats = _named(index.features, names).join(F.broadcast(asked), ["kind", "feature"]).crossJoin(F.broadcast(index.n_notes))
    w = idf(F.col("n"), F.col("df")) * F.when(F.col("kind") == "term", 2.0).otherwise(1.0)
    heavy = Window.partitionBy("query_id").orderBy(F.col("w").desc(), "kind", "feature")
    weighed = cut(stats.select("query_id", "kind", "feature", "df", w.alias("w"))
                  .withColumn("before", F.sum("df").over(heavy) - F.col("df")).withColumn("bound", F.sum("w").over(Window.partitionBy("query_id")) - F.sum("w").over(heavy) + F.col("w")))

    def postings(some: DataFrame) -> DataFrame:
        """query_id, block, note_ord, w of weighed features."""
        own = [r[0] for r in some.select("feature").distinct().collect()]
        return _named(index.blocks, own).join(F.broadcast(some.select("query_id", "kind", "feature", "w")), ["kind", "feature"])

    def summed(some: DataFrame) -> DataFrame:
        notes = some.select("query_id", "block", F.explode("places").alias("at"), "w")
        return notes.groupBy("query_id", "block", "at").agg(F.sum("w").alias("s"))

    first = search.top(summed(postings(weighed.where(F.col("before") < lead))).select("query_id", (F.col("block") * BLOCK + F.col("at")).alias("note_ord"), F.col("s").alias("score")), k)
    floors = first.where(F.col("rank") == k).select("query_id", (F.col("score") - _MARGIN).alias("floor"))
    split = cut(weighed.join(F.broadcast(floors), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("makes", F.col("bound") >= F.col("floor")))
    rest = split.where("not makes").groupBy("query_id").agg(F.sum("w").alias("rest"))
    floor = split.groupBy("query_id").agg(F.first("floor").alias("floor")).join(rest, "query_id", "left")
    found = summed(postings(split.where("makes"))).join(F.broadcast(floor), "query_id")
    candidates = cut(found.where(F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor")).select("query_id", "block", "at", "s"))
    opened = candidates.select("query_id", "block").distinct()
    more = postings(split.where("not makes")).join(opened, ["query_id", "block"], "left_semi")
    added = more.select("query_id", "block", F.explode("places").alias("at"), "w").join(candidates.select("query_id", "block", "at"), ["query_id", "block", "at"], "left_semi")
    every = candidates.unionByName(added.withColumnRenamed("w", "s")).groupBy("query_id", "block", "at").agg(round4(F.sum("s")).alias("score"))
    return search.top(every.select("query_id", (F.col("block") * BLOCK + F.col("at")).alias("note_ord"), "score"), k).select("query_id", "rank", "note_ord", "score")
