"""Features of notes, counted many notes at a time within a task: no posting becomes a row.

Character n-grams are numbers, of as many bits a character as the slice's characters need, words are Arrow dictionaries. Of each
slice of about ``SLICE`` code points a task returns a row a feature (and block), so that rows are few and memory is that of a slice.
Lower case and word characters are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import word_text
from notegraph.shipping import ship

SLICE = 1 << 21
#: Notes of neighbouring numbers that go to one task together.
TOGETHER = 1 << 11


def _prepared(dealt: DataFrame) -> DataFrame:
    """note_ord; low, the text in lower case; clean, the same with a space for each character that is not of a word."""
    return dealt.withColumn("clean", word_text(F.col("low")))


def _slices(batches, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column("low")).to_numpy())
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, size + (ends[low - 1] if low else 0), side="right")))
            yield batch.slice(low, high - low)
            low = high


class _Runs:
    """Texts laid end to end: each character as its rank among those that occur, and its text's owner (of n)."""

    def __init__(self, texts: pa.Array, owner: np.ndarray, n: int):
        every = texts.to_pylist()
        self.sizes = np.fromiter(map(len, every), np.int64, len(every))
        c = np.frombuffer("".join(every).encode("utf-32-le"), np.uint32)
        self.chars = np.flatnonzero(np.bincount(c)).astype(np.uint32)
        rank = np.zeros(int(self.chars[-1]) + 1 if len(self.chars) else 0, np.int64)
        rank[self.chars] = np.arange(len(self.chars))
        self.c, self.of, self.n = rank[c], np.repeat(owner, self.sizes), n

    def without(self, char: str) -> np.ndarray:
        """Which characters are others than this one."""
        at = np.flatnonzero(self.chars == ord(char))
        return self.c != at[0] if len(at) else np.ones(len(self.c), bool)

    def grams(self, n: int, held: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The n-grams of held characters, and the different pairs of gram and owner, in order."""
        bits, most, ends = len(self.chars).bit_length(), max(len(self.c) - n + 1, 0), np.cumsum(self.sizes)
        code, keep = np.zeros(most, np.int64), np.ones(most, bool)
        for i in range(n):
            code = code << bits | self.c[i : most + i]
            if held is not None:
                keep &= held[i : most + i]
        for i in range(1, n):  # the last of each text have no n characters from there
            at = ends[self.sizes >= i] - i
            keep[at[at < most]] = False
        known, at, of = _pairs(code[keep], self.of[:most][keep], self.n, n * bits)
        shifts = np.arange(n - 1, -1, -1) * bits
        s = self.chars[known[:, None] >> shifts & (1 << bits) - 1].tobytes().decode("utf-32-le")
        return [s[i : i + n] for i in range(0, len(s), n)], at, of


def _pairs(code: np.ndarray, owner: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of codes of so many bits and owners (of n): the different codes, and the different pairs of code, by its place among them, and owner, in order."""
    if bits + n.bit_length() > 63:
        codes, at = np.unique(code, return_inverse=True)
        ranks, at, of = _pairs(at, owner, n, len(codes).bit_length())
        return codes[ranks], at, of
    key = np.sort(code << n.bit_length() | owner)
    key = key[np.diff(key, prepend=-1) != 0]
    code, of = key >> n.bit_length(), key & (1 << n.bit_length()) - 1
    first = np.diff(code, prepend=-1) != 0
    return code[first], np.cumsum(first) - 1, of


def _found(rows: pa.RecordBatch, owner: np.ndarray, n: int) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
    """kind, features, and the pairs of feature and owner, some features at a time."""
    low = _Runs(rows.column("low"), owner, n)
    for size in (2, 3):
        yield "gram", *low.grams(size)
    clean = _Runs(rows.column("clean"), owner, n)
    yield "term", *clean.grams(2, clean.without(" "))
    words = pc.split_pattern(rows.column("clean"), " ")
    long = pc.greater_equal(pc.utf8_length(words.flatten()), 3)
    coded = words.flatten().filter(long).dictionary_encode()
    of = owner[pc.list_parent_indices(words).filter(long).to_numpy()]
    known, at, of = _pairs(coded.indices.to_numpy().astype(np.int64), of, n, len(coded.dictionary).bit_length())
    yield "term", coded.dictionary.take(pa.array(known)).to_pylist(), at, of


def _counted(size: int):
    """To kind, feature and the number of rows that have it, of each slice."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, size):
            for kind, names, at, _ in _found(rows, np.arange(rows.num_rows), rows.num_rows):
                df = np.bincount(at, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(df, pa.int64())], names=["kind", "feature", "df"])

    return run


def _blocked(block: int, size: int):
    """To kind, feature, block and the sorted places in it. Rows come in order of note_ord; rows of one number are one note."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for rows in _slices(batches, size):
            ords, owner = np.unique(rows.column("note_ord").to_numpy(), return_inverse=True)
            told: dict[str, set] = {"gram": set(), "term": set()}
            for kind, names, at, of in _found(rows, owner, len(ords)):
                mine = {names[i] for i in at[of == len(ords) - 1]}
                if ords[0] == last:  # the note goes on: what it was told to have is left out
                    first = np.flatnonzero(of == 0)
                    old = first[[names[i] in held[kind] for i in at[first]]] if len(first) else first
                    at, of = np.delete(at, old), np.delete(of, old)
                told[kind] |= mine
                b = ords[of] // block
                starts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(b, prepend=b[:1]) != 0))
                places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)].astype(np.int32)), pa.array((ords[of] % block).astype(np.int16)))
                feature = pa.array(names, pa.string()).take(pa.array(at[starts]))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(starts), pa.string()), feature, pa.array(b[starts], pa.int64()), places], names=["kind", "feature", "block", "places"])
            if len(ords) == 1 and ords[0] == last:
                told = {kind: told[kind] | held[kind] for kind in told}
            last, held = ords[-1], told

    return run


def _parts(notes: DataFrame) -> int:
    ship(notes.sparkSession)
    return int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def counts(notes: DataFrame, text: Column) -> DataFrame:
    """kind, feature, df: in how many rows of notes(note_ord, …) the text has each feature."""
    dealt = notes.select("note_ord", F.lower(text).alias("low")).repartition(_parts(notes), "note_ord")
    return _prepared(dealt).mapInArrow(_counted(SLICE), "kind string, feature string, df long").groupBy("kind", "feature").agg(F.sum("df").alias("df"))


def blocks(notes: DataFrame, text: Column, block: int) -> DataFrame:
    """kind, feature, block, places: sorted, in some rows a block, of which no two hold the same place."""
    known = notes.where("note_ord is not null").select(F.col("note_ord").cast("long").alias("note_ord"), F.lower(text).alias("low"))
    dealt = known.repartition(_parts(notes), F.floor(F.col("note_ord") / TOGETHER)).sortWithinPartitions("note_ord")
    return _prepared(dealt).mapInArrow(_blocked(block, SLICE), "kind string, feature string, block long, places array<smallint>")
