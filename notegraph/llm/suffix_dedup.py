"""Exact substring deduplication by ranks of ever longer prefixes.

A byte goes if some string of ``length`` bytes that covers it starts anywhere else.
Prefix doubling ranks the strings that start at each position by ever longer prefixes:
Spark sorts (rank, position) rows, positions whose rank nobody shares drop out, and
the others are ranked anew by the pair of their rank and the one as far ahead as the
prefix is long, until unique or past the threshold. ``repeated_by_doubling`` is that, a
row for each byte of text in the first round, which fits small tables only (the README
has figures). ``remove_repeats``, for tables of any size, keeps the rounds and their
sorts but not the doubling of offsets: its ranks are hashes, equal for equal strings, so
the rank of a longer string comes from the text at any position and in any task, and
the first rounds rank samples and ranges of positions.

Three rounds do, as neighbouring positions share most of their strings:

1. Of the positions in every string at least one is a *seed*, chosen by winnowing the
   hashes of ``SEED_BYTES`` bytes, so equal strings hold the same seed at the same
   place. Neighbouring positions with one seed are a *stretch*. Seeds nobody shares
   drop out.
2. A stretch whose whole range of bytes repeats goes as a whole. Where stretches of one
   seed differ, cells of ``CELL`` positions are ranked over the bytes that all strings
   of the cell share, and over all bytes they span: the first unshared, a cell drops
   out; the second shared, it goes as a whole.
3. Where cells of one shared core differ, single positions are ranked over all
   ``length`` bytes.

Of equal stretches or cells one stands for all in the next round, with a weight of two,
so groups of copies are compared once. Nothing is capped: equal rows are added up
before the shuffle, and are joined back in joins whose one side has a row a rank.

Edge cases: null, empty and short texts lose nothing. A very long text is a block of its
own; its strings count like those of many texts. Rows that repeat (same id, same text)
repeat each other's strings like any two texts; all of them lose what repeats, as do all
of any equal strings (a tie). Texts that share an id, or have none, are told apart by
what they hold. An empty table gives an empty result. Columns other than doc_id and text
are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import ROW_KEY, ROW_KEY_SCHEMA, Roller, id_of, least_places, map_blocks, mix, row_key, stored

LENGTH = 200
SEED_BYTES = 48
CELL = 16


class Stretches:
    """A block's sampled seeds: which string starts belong to each, and two hashes of all they span."""

    def __init__(self, off: np.ndarray, data: np.ndarray, length: int, seed: int):
        self.off, self.length = off, length
        self.rollers = Roller(0), Roller(1)
        self.prefix = [r.prefix(data) for r in self.rollers]
        count = np.maximum(np.diff(off) - length + 1, 0)  # string starts of each text
        empty = np.zeros(0, np.int64)
        self.doc, self.first, self.last, self.ordinal = empty, empty, empty, empty
        self.seed_at, self.seed_hash, self.name = empty, np.zeros(0, np.uint64), np.zeros((2, 0), np.uint64)
        if not count.any():
            return
        width = length - seed + 1
        hashes = mix(self.rollers[0].windows(self.prefix[0], seed))
        winner = least_places(hashes, width)
        starts = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        doc = np.repeat(np.arange(len(count)), count)
        chosen = winner[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.doc, self.first = doc[at], starts[at]
        self.last = starts[np.append(at[1:], len(starts)) - 1]
        self.ordinal = np.arange(len(at)) - np.searchsorted(self.doc, self.doc)
        self.seed_at, self.seed_hash = chosen[at], hashes[chosen[at]]
        end = self.last + length
        # Where the seed lies in the stretch is part of its name.
        shift = mix((chosen[at] - self.first).astype(np.uint64) + np.uint64(0x1234567))
        self.name = np.stack([r.spans(p, self.first, end) ^ shift for r, p in zip(self.rollers, self.prefix)])

    def names(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(r.spans(p, start, end) for r, p in zip(self.rollers, self.prefix))


#: A rank's row: what must be shared at least (key), the rank of all it spans (n1, n2), and where it is.
_ROWS = f"key long, n1 long, n2 int, {ROW_KEY_SCHEMA}, place long, copies int"


def _rows(batch, doc, key, names, place, copies) -> pa.RecordBatch:
    take = pa.array(doc)
    short = (names[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    cols = [pa.array(key.view(np.int64)), pa.array(names[0].view(np.int64)), pa.array(short), *(batch.column(i).take(take) for i in range(3))]
    cols += [pa.array(place.astype(np.int64)), pa.array(copies.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, names=["key", "n1", "n2", *ROW_KEY, "place", "copies"])


def _stretches(length: int, seed: int):
    def block(batch, off, data):
        s = Stretches(off, data, length, seed)
        if not len(s.doc):
            return None
        # Stretches that repeat within a text are sent once, with their number.
        within = s.name[0] ^ mix(s.doc.astype(np.uint64) + np.uint64(99))
        _, at, copies = np.unique(within, return_index=True, return_counts=True)
        return _rows(batch, s.doc[at], s.seed_hash[at], s.name[:, at], s.ordinal[at], copies)

    return map_blocks(block)


def _asked(batch, s: Stretches):
    """What a text's rows ask for: (stretch, text, place, weight) arrays, or None."""
    begin = np.searchsorted(s.doc, np.arange(batch.num_rows + 1))
    rows = [(d, p, w) for d, asked in enumerate(batch.column(4).to_pylist()) for p, w in zip((x["place"] for x in asked), (x["weight"] for x in asked))]
    if not rows:
        return None
    d, place, weight = (np.array(x, np.int64) for x in zip(*rows))
    return begin, d, place, weight


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and whose each is."""
    n = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


def _cells(length: int, seed: int):
    """Stretches asked for -> their cells: positions by how far they lie before the seed."""

    size = min(CELL, length - seed + 1)  # so that what the strings of a cell share holds the seed

    def block(batch, off, data):
        s = Stretches(off, data, length, seed)
        asked = _asked(batch, s)
        if asked is None:
            return None
        begin, d, ordinal, weight = asked
        at = begin[d] + ordinal
        seed_at = s.seed_at[at]
        near, far = seed_at - s.last[at], seed_at - s.first[at]
        cell, whose = _ranges(near // size, far // size)
        p, lo, hi = seed_at[whose], np.maximum(cell * size, near[whose]), np.minimum(cell * size + size - 1, far[whose])
        # All strings of a cell, of any text that has one, share these bytes.
        core = s.names(p - cell * size, p - (cell * size + size - 1) + length)[0] ^ mix(cell.astype(np.uint64) + np.uint64(7))
        first, last = p - hi, p - lo
        shift = mix((p - first).astype(np.uint64) + np.uint64(0x1234567))
        spans = [n ^ shift for n in s.names(first, last + length)]
        place = ((first - off[d[whose]]) << 8) | (last - first + 1)
        return _rows(batch, d[whose], core, spans, place, weight[whose])

    return map_blocks(block)


def _positions(length: int, seed: int):
    """Cells asked for -> their positions, by the whole string."""

    def block(batch, off, data):
        s = Stretches(off, data, length, seed)
        asked = _asked(batch, s)
        if asked is None:
            return None
        _, d, place, weight = asked
        first = off[d] + (place >> 8)
        start, whose = _ranges(first, first + (place & 255) - 1)
        names = s.names(start, start + length)
        return _rows(batch, d[whose], names[0], names, ((start - off[d[whose]]) << 8) | 1, weight[whose])

    return map_blocks(block)


_OWN, _NAME = ROW_KEY, ["key", "n1", "n2"]


def _round(rows: DataFrame, more: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """rows of one round -> (id, text_key, places that repeat whole), and what to ask in the next.

    Asked is one row of each rank whose key is shared by others of another rank, with a
    weight of its copies, two at most.
    """
    rows = stored(rows)
    shared = rows.groupBy("key").agg(F.sum("copies").alias("c"), F.min("n1").alias("lo"), F.max("n1").alias("hi"))
    live = stored(shared.where("c > 1").select("key", (F.col("lo") != F.col("hi")).alias("varied")))
    rows = stored(rows.join(live, "key"))
    ranks = stored(rows.groupBy(*_NAME, "varied").agg(F.sum("copies").alias("c"), F.min(F.struct(*ROW_KEY, "place")).alias("least")))
    whole = rows.join(ranks.where("c > 1").select(*_NAME), _NAME, "left_semi").groupBy(*_OWN).agg(F.collect_set("place").alias("places"))
    if not more:
        return stored(whole), None
    asked = ranks.where("varied").select("least.*", F.least("c", F.lit(2)).cast("int").alias("weight"))
    return stored(whole), stored(asked.groupBy(*_OWN).agg(F.collect_list(F.struct("place", "weight")).alias("asked")))


_REMOVED = "removed array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _remove(length: int, seed: int):
    """Texts with repeated stretches and ranges of positions -> what is removed, and what stays."""

    def block(batch, off, data):
        s = Stretches(off, data, length, seed)
        whole, parts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        delta = np.zeros(len(data) + 1, np.int64)
        begin = np.searchsorted(s.doc, np.arange(len(off)))
        for d, (ordinals, places) in enumerate(zip(whole, parts)):
            if ordinals:
                # An ordinal stands for all stretches of its text with the same name.
                own = slice(begin[d], begin[d + 1])
                at = begin[d] + np.flatnonzero(np.isin(s.name[0][own], s.name[0][begin[d] + np.array(ordinals)]))
                np.add.at(delta, s.first[at], 1)
                np.add.at(delta, s.last[at] + length, -1)
            if places:
                p = np.array(places, np.int64)
                first = off[d] + (p >> 8)
                np.add.at(delta, first, 1)
                np.add.at(delta, first + (p & 255) - 1 + length, -1)
        gone = np.cumsum(delta)[:-1] > 0
        spans, kept = [], []
        for d in range(len(off) - 1):
            g = gone[off[d] : off[d + 1]]
            if g.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            else:
                spans.append([])
            kept.append(data[off[d] : off[d + 1]][~g].tobytes())
        cols = [pa.array(np.diff(off)), pa.array(spans, _SPANS), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(6), *cols], names=["doc_id", "n_bytes", "removed", "kept"])

    return map_blocks(block)


def _first_ranks(size: int):
    def block(batch, off, data):
        roller = Roller(0)
        count = np.maximum(np.diff(off) - size + 1, 0)
        start = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        doc = np.repeat(np.arange(len(count)), count)
        if not len(doc):
            return None
        rank = mix(roller.windows(roller.prefix(data), size))[start]
        take = pa.array(doc)
        cols = [*(batch.column(i).take(take) for i in range(4)), pa.array(start - off[doc]), pa.array(rank.view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=[*ROW_KEY, "copies", "pos", "rank"])

    return map_blocks(block)


def repeated_by_doubling(docs: DataFrame, length: int = LENGTH, first: int = 25) -> DataFrame:
    """(row key, pos) of every string of ``length`` bytes in docs(doc_id, text) that starts elsewhere, too; length is first, doubled some times."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(*row_key(F.col("doc_id"), text), text.alias("text")).groupBy(*ROW_KEY).agg(F.count("*").cast("int").alias("copies"), F.first("text").alias("text"))
    ranks, size = texts.mapInArrow(_first_ranks(first), f"{ROW_KEY_SCHEMA}, copies int, pos long, rank long"), first
    while True:
        ranks = stored(ranks)
        shared = stored(ranks.groupBy("rank").agg(F.sum("copies").alias("c")).where("c > 1").select("rank"))
        ranks = ranks.join(shared, "rank")
        if size >= length:
            return ranks.select(*ROW_KEY, "pos")
        ahead = ranks.select(*ROW_KEY, (F.col("pos") - size).alias("pos"), F.col("rank").alias("ahead"))
        ranks = ranks.join(ahead, [*ROW_KEY, "pos"]).select(*ROW_KEY, "copies", "pos", F.xxhash64("rank", "ahead").alias("rank"))
        size *= 2


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, removed (byte spans), kept (the other bytes)."""
    if not 1 <= seed <= length // 2:
        raise ValueError("seeds must fit half a string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*row_key(F.col("doc_id"), text), text.alias("text"))
    long = rows.where(F.octet_length("text") >= length)
    whole, asked = _round(long.mapInArrow(_stretches(length, seed), _ROWS))
    cells, asked = _round(long.join(asked, _OWN).mapInArrow(_cells(length, seed), _ROWS))
    single, _ = _round(long.join(asked, _OWN).mapInArrow(_positions(length, seed), _ROWS), more=False)
    parts = cells.unionByName(single).groupBy(*_OWN).agg(F.flatten(F.collect_list("places")).alias("parts"))
    marks = whole.withColumnRenamed("places", "whole").join(parts, _OWN, "full")
    return (
        rows.join(marks, _OWN, "left").select(*_OWN, "text", "whole", "parts", id_of(F.col("no_id"), F.col("id")).alias("doc_id"))
        .mapInArrow(_remove(length, seed), f"doc_id long, n_bytes long, {_REMOVED}, kept binary")
    )


def digest(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
