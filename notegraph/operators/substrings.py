"""Substring join: which texts contain which needles, by automata over blocks of needles.

The different needles are cut into blocks of at most ``BLOCK_CHARS`` characters. Of each block every task
builds an Aho-Corasick automaton and passes once over each text of its partition where it lies: time is linear
in the text and what it contains, memory in the block and the longest text. No text is shuffled or stands
beside a key; a row is made for a pair that holds alone. One block, the usual case, takes one pass and
stays lazy; more are stored one after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.lineage import cut, shared_dir
from notegraph.shipping import ship

BLOCK_CHARS = 1 << 20
_made: dict = {}


class Finder:
    """A mapInArrow function from rows (h, t) to (h, s) for every needle s in t."""

    def __init__(self, needles: list[str]):
        self.needles, self.key = needles, uuid.uuid4().hex

    def automaton(self):
        """Once a worker, as it may run many tasks of a block."""
        if self.key not in _made:
            import ahocorasick

            tree = ahocorasick.Automaton()
            for s in self.needles:
                tree.add_word(s, s)
            tree.make_automaton()
            _made.clear()
            _made[self.key] = tree
        return _made[self.key]

    def within(self, text: str) -> set[str]:
        held: set[str] = set()
        for _, s in self.automaton().iter(text):
            held.add(s)
            if len(held) == len(self.needles):
                break
        return held

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not self.needles:
                return
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                held = self.within(text)
                at += [i] * len(held)
                found += held
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=["h", "s"])


def contained(needles: DataFrame, hay: DataFrame, block: int = BLOCK_CHARS) -> DataFrame:
    """needles(n, s) and hay(h, t) -> (n, h) where t contains s, neither empty."""
    spark = hay.sparkSession
    ship(spark)
    texts = hay.where("t <> ''").select("h", "t")
    # A needle longer than every text lies in none; without texts there is nothing to look for.
    longest = texts.agg(F.max(F.length("t"))).first()[0] or 0
    needles = cut(needles.where("s <> ''").where(F.length("s") <= longest).select("n", "s"))
    words = needles.select("s").distinct()
    blocks = max(1, -(-(words.agg(F.sum(F.length("s"))).first()[0] or 0) // block))
    schema = f"h {hay.schema['h'].dataType.simpleString()}, s string"
    part = lambda i: (words if blocks == 1 else words.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == i)).toArrow().column(0).to_pylist()
    if blocks == 1:
        found = texts.mapInArrow(Finder(part(0)), schema)
    else:
        out = f"{shared_dir(spark).rstrip('/')}/contained-{uuid.uuid4().hex}"
        for i in range(blocks):
            texts.mapInArrow(Finder(part(i)), schema).write.mode("append").parquet(out)
        found = spark.read.schema(schema).parquet(out)
    return found.join(needles, "s").select("n", "h")
