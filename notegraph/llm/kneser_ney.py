"""An interpolated modified Kneser-Ney language model, and texts' log-probabilities.

The model is of any order from two on (``ORDER`` by default). Counting takes a pass over
the texts for words and one for n-grams, then a step for each lower order:

1. word counts, dealt out by ranges of the words' 64-bit hashes. Each range is written
   as a sorted array, and numbers its words by frequency, in steps of the number of
   ranges, so that frequent words have small numbers and n-grams pack well;
2. n-grams of word numbers, dealt out by ranges of their hashes and written as sorted
   hash arrays with their counts. Each range sends on, for every n-gram, that its last
   words follow one word more, and what its first words lead to;
3. the same for the n-grams shorter by one, whose counts are those of the different
   words before them, and so on down to single words.

Tasks count locally and ship each range as one compressed block of numbers, so a
shuffle row is a block and not a word; an n-gram's range depends on all its words, so
no frequent word weighs on one range. What one order sends to the next lies beside the
arrays until it is read, so that the larger shuffle before it can go. Ranges hold about ``RANGE_TOKENS`` tokens at any
size of the corpus. The arrays lie in the folder that driver and executors share;
workers map them into memory, look up the distinct n-grams of a block of texts in
sorted order and add up log-probabilities. That folder must be mounted as a path.

Edge cases: null and empty texts consist of the end token alone. A very long text is a
block of its own; what it holds is counted and scored like any other text. A null doc_id
counts as the empty text in the hash that holds rows out. Rows that repeat count and are
scored as often as they occur. Ties do not arise: the score of a row depends on counts
alone. Without training rows all words are unknown and the model is uniform over its one
word class; an empty table gives an empty result. Columns other than doc_id and text are
ignored, whatever they are called.
"""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import LOWER, WHITE, Roller, gathered, map_blocks, mix, owners, segment_sum, shared_dir, text_buffers, words
from notegraph.llm.common import blocks as text_blocks

ORDER = 3
RANGE_TOKENS = 2_000_000
_LOCAL_GRAMS = 3_000_000
_BLOCK_BYTES = 2 << 20  # each block visits all ranges it has words in, so blocks are larger here
_END = np.uint64(0x5851F42D4C957F2D)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_U32 = np.uint64(32)
_BLOCKS = "range int, block binary"


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the shared folder must be mounted as a path to map files into memory: {path}")
    return path


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers byte plane by byte plane; the first, best in order, as differences."""
    first = columns[0].astype(np.uint64)
    columns = [np.diff(first, prepend=np.uint64(0)), *columns[1:]]
    widths = [next(w for w in (1, 2, 4, 8) if int(c.max(initial=0)) < 1 << 8 * w) for c in columns]
    planes = [np.ascontiguousarray(c.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T).tobytes() for c, w in zip(columns, widths)]
    return struct.pack("<QB", len(first), len(widths)) + bytes(widths) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<QB", blob)
    widths, at, out = blob[9 : 9 + k], 0, []
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9 + k :], max_output_size=n * sum(widths) + 1), np.uint8)
    for w in widths:
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(f"<u{w}"))
        at += n * w
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def add_up(hashes: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """One row of each hash, in order: its columns, and the sums of its counts."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    total = lambda c: np.add.reduceat(c[order], at, dtype=np.int64) if len(at) else c[:0].astype(np.int64)
    return hashes[at], [c[order[at]] for c in columns], [total(c) for c in counts]


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit hashes each lies in."""
    return (((hashes >> _U32) * np.uint64(n)) >> _U32).astype(np.int64)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams of word numbers."""
    out = mix(columns[0].astype(np.uint64) + _TIMES)
    for c in columns[1:]:
        out = mix(out * _TIMES + c.astype(np.uint64))
    return out


def word_hashes(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's tokens, each text's end token included, and tokens per text."""
    low = LOWER[data]
    roller = Roller(0)
    start, end, per = words(low, off, ~WHITE)
    out = np.full(len(start) + len(per), _END, np.uint64)
    out[np.arange(len(start)) + owners(per)] = roller.spans(roller.prefix(low), start, end)
    return out, per + 1


# -------------------------------------------------------------------- counting


def _dealt(hashes: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray], ranges: int) -> dict[int, bytes]:
    """Rows of distinct hashes as one block a range."""
    r = range_of(hashes, ranges)
    # Like numbers side by side are smaller; the order within a block means nothing.
    near = columns[0].astype(np.uint64) if len(columns) == 1 else (columns[0].astype(np.uint64) << _U32) ^ columns[1].astype(np.uint64)
    order = np.lexsort((near, r))
    cuts = np.searchsorted(r[order], np.arange(ranges + 1))
    return {int(i): pack([c[order[cuts[i] : cuts[i + 1]]] for c in (*columns, *counts)]) for i in np.flatnonzero(np.diff(cuts))}


class _Tally:
    """Local counts of n-grams by hash, shipped by range once they are many."""

    def __init__(self, ranges: int):
        self.ranges, self.parts, self.size = ranges, [], 0

    def add(self, hashes: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        distinct, at, counts = np.unique(hashes, return_index=True, return_counts=True)
        self.parts.append((distinct, [c[at] for c in columns], [counts]))
        self.size += len(distinct)
        if self.size > _LOCAL_GRAMS:
            self._merge()
            if self.size > _LOCAL_GRAMS * 2 // 3:
                yield from self.ship()

    def _merge(self) -> None:
        hashes, columns, counts = zip(*self.parts)
        self.parts = [add_up(np.concatenate(hashes), list(map(np.concatenate, zip(*columns))), list(map(np.concatenate, zip(*counts))))]
        self.size = len(self.parts[0][0])

    def ship(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            (part,), self.parts, self.size = self.parts, [], 0
            blocks = _dealt(*part, self.ranges)
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(list(blocks.values()), pa.binary())], names=["range", "block"])


def _text_blocks(batches):
    for batch in batches:
        off, data = text_buffers(batch.column(batch.schema.get_field_index("text")))
        for i, j in text_blocks(off, _BLOCK_BYTES):
            yield off[i : j + 1] - off[i], data[off[i] : off[j]]


def _ship_words(ranges: int):
    def run(batches):
        tally = _Tally(ranges)
        for off, data in _text_blocks(batches):
            hashes = word_hashes(off, data)[0]
            yield from tally.add(hashes, [hashes])
        yield from tally.ship()

    return run


def _ship_grams(model: Model):
    def run(batches):
        tally = _Tally(model.ranges)
        for off, data in _text_blocks(batches):
            hashes, per = word_hashes(off, data)
            padded, place = model.padded(model.numbers(hashes)[0], per)
            columns = [padded[place - k] for k in range(model.order - 1, -1, -1)]
            yield from tally.add(gram_hash(columns), columns)
        yield from tally.ship()

    return run


def _by_range(batches, n_columns: int):
    """A task's blocks, one range at a time: its columns, and counts not yet added up."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for r, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(r, []).append(b)
    for r in sorted(held):
        every = [np.concatenate(c) for c in zip(*map(unpack, held.pop(r)))]
        yield r, every[:n_columns], every[n_columns:]


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Written beside and renamed: a task that runs again leaves the same file."""
    path = f"{folder}/{name}.npy"
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _save_table(folder: str, level: int, r: int, hashes: np.ndarray, counts: list[np.ndarray]) -> None:
    """Sorted hashes, a byte for each count, and what a byte cannot hold."""
    table = np.stack(counts, 1) if len(hashes) else np.zeros((0, len(counts)), np.int64)
    large = np.flatnonzero(table.reshape(-1) >= 255)
    _save(folder, f"hash-{level}-{r:06d}", hashes)
    _save(folder, f"small-{level}-{r:06d}", np.minimum(table, 255).astype(np.uint8))
    _save(folder, f"large-{level}-{r:06d}", np.stack([large, table.reshape(-1)[large]]))


def _write_words(folder: str):
    def run(batches):
        for r, (hashes,), counts in _by_range(batches, 1):
            hashes, _, counts = add_up(hashes, [], counts)
            _save_table(folder, 0, r, hashes, counts)
            rank = np.empty(len(hashes), np.uint32)
            rank[np.argsort(-counts[0], kind="stable")] = np.arange(len(hashes))
            _save(folder, f"rank-{r:06d}", rank)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([len(hashes)]), pa.array([int(counts[0].sum())])], names=["range", "size", "tokens"])

    return run


def _shorter(columns: list[np.ndarray], count: np.ndarray, ranges: int) -> dict[int, bytes]:
    """What distinct n-grams tell of those shorter by one, as blocks by range.

    Counts: different words before them, all that follows them, and how many different
    words follow them once, twice, and more often.
    """
    n = len(count)
    both = [np.concatenate([b, a]) for a, b in zip(columns[:-1], columns[1:])]
    hashes, at, back = np.unique(gram_hash(both), return_index=True, return_inverse=True)
    add = lambda i, w=None: np.bincount(i, w, len(hashes)).astype(np.int64)
    leads, kind = back[n:], np.minimum(count, 3)
    counts = [add(back[:n]), add(leads, count), *(add(leads[kind == k]) for k in (1, 2, 3))]
    return _dealt(hashes, [c[at] for c in both], counts, ranges)


def _write(folder: str, level: int, r: int, columns: list[np.ndarray], counts: list[np.ndarray], ranges: int) -> None:
    """Writes a range's arrays of one order, and beside them what they tell of the next lower one."""
    hashes, columns, counts = add_up(gram_hash(columns), columns, counts)
    _save_table(folder, level, r, hashes, counts)
    c = counts[0]
    _save(folder, f"sums-{level}-{r:06d}", np.array([c.sum(), *((c == k).sum() for k in (1, 2, 3, 4)), (c >= 3).sum()], np.int64))
    if level > 1:
        seen = c > 0  # what only leads on, like the beginning of a text, is no n-gram of its own
        blocks = _shorter([x[seen] for x in columns], c[seen], ranges)
        ends = np.cumsum([len(blocks.get(i, b"")) for i in range(ranges)])
        _save(folder, f"told-{level - 1}-{r:06d}", np.frombuffer(b"".join(blocks[i] for i in sorted(blocks)), np.uint8))
        _save(folder, f"ends-{level - 1}-{r:06d}", np.concatenate([[0], ends]))


def _write_top(folder: str, level: int, ranges: int):
    def run(batches):
        for r, columns, counts in _by_range(batches, level):
            _write(folder, level, r, columns, counts, ranges)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64())], names=["range"])

    return run


def _write_lower(folder: str, level: int, ranges: int, above: np.ndarray):
    """For each range, what all ranges of the order above that hold anything tell of it; yields those that then hold something."""

    def told(r: int) -> Iterator[bytes]:
        for source in np.flatnonzero(above).tolist():
            lo, hi = np.load(f"{folder}/ends-{level}-{source:06d}.npy", mmap_mode="r")[r : r + 2].tolist()
            if lo < hi:
                yield np.load(f"{folder}/told-{level}-{source:06d}.npy", mmap_mode="r")[lo:hi].tobytes()

    def run(batches):
        for batch in batches:
            held = []
            for r in batch.column(0).to_pylist():
                if every := [np.concatenate(c) for c in zip(*map(unpack, told(r)))]:
                    _write(folder, level, r, every[:level], every[level:], ranges)
                    held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["range"])

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from counts of counts, held within their counts."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 1.5)
    return tuple(float(min(max(x, 0.05), k - 0.05)) for k, x in enumerate(d, 1))


# ----------------------------------------------------------------------- model


@dataclass
class Model:
    folder: str
    order: int
    ranges: int
    tokens: int = 0
    types: int = 0
    bound: int = 0  # over all words' numbers: it stands for the beginning of a text, the next one for an unknown word
    discounts: list[tuple] = field(default_factory=list)  # from single words up
    followed: int = 0
    rest: float = 1.0
    held: dict[int, np.ndarray] = field(default_factory=dict)  # by order, which ranges hold anything: their files must be there

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    @cached_property
    def files(self) -> dict[tuple[int, int], tuple | None]:
        return {}

    def table(self, level: int, r: int) -> tuple | None:
        """A range's arrays, mapped into memory; None if it holds nothing. That its file is lost is an error."""
        if level not in self.held or not self.held[level][r]:
            return None
        if (level, r) not in self.files:
            paths = [f"{self.folder}/{name}-{level}-{r:06d}.npy" for name in ("hash", "small", "large")]
            paths += [f"{self.folder}/rank-{r:06d}.npy"] * (level == 0)
            got = tuple(np.load(p, mmap_mode="r") for p in paths)
            self.files[level, r] = got if len(got[0]) else None
        return self.files[level, r]

    def find(self, level: int, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For sorted hashes: their numbers, if they are words, and their counts."""
        number, counts = np.full(len(hashes), self.bound + 1, np.int64), np.zeros((len(hashes), width), np.int64)
        cuts = np.searchsorted(range_of(hashes, self.ranges), np.arange(self.ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            if (held := self.table(level, r)) is None:
                continue
            keys, small, large, *rank = held
            part = slice(cuts[r], cuts[r + 1])
            at = np.minimum(np.searchsorted(keys, hashes[part]), len(keys) - 1)
            found = np.flatnonzero(keys[at] == hashes[part])
            at = at[found]
            rows = small[at].astype(np.int64)
            i, j = np.nonzero(rows == 255)
            if len(i):
                rows[i, j] = large[1][np.searchsorted(large[0], at[i] * width + j)]
            counts[part.start + found] = rows
            if rank:
                number[part.start + found] = rank[0][at].astype(np.int64) * self.ranges + r
        return number, counts

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (that of no word if unknown) and counts."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, counts = self.find(0, distinct, 1)
        return number.astype(np.uint32 if self.bound + 2 < 1 << 32 else np.uint64)[back], counts[back, 0]

    def padded(self, number: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with the mark of their beginning before them, once less than the order; and where the tokens then are."""
        ahead = self.order - 1
        place = np.arange(len(number)) + (owners(per) + 1) * ahead
        out = np.full(len(number) + len(per) * ahead, self.bound, number.dtype)
        out[place] = number
        return out, place

    def log10(self, number: np.ndarray, per: np.ndarray) -> np.ndarray:
        """log10 probability of every token of a block."""
        padded, place = self.padded(number, per)
        shown = np.union1d(place, place - 1)  # tokens, and each text's last mark before it
        now, before = np.searchsorted(shown, place), np.searchsorted(shown, place - 1)
        p, context = None, None
        for level in range(1, self.order + 1):
            top = level == self.order
            at = place if top else shown
            distinct, back = np.unique(gram_hash([padded[at - k] for k in range(level - 1, -1, -1)]), return_inverse=True)
            counts = self.find(level, distinct, 1 if top else 5)[1][back]
            d = np.array([0.0, *self.discounts[level - 1]])
            c = counts[:, 0] if top else counts[now, 0]
            own = np.maximum(c - d[np.minimum(c, 3)], 0)
            if p is None:
                p = self.rest / (self.types + 1) + own / max(self.followed, 1)
            else:
                total, lost = context[:, 1], context[:, 2:] @ d[1:]
                p = np.where(total > 0, (own + lost * p) / np.maximum(total, 1), p)
            context = None if top else counts[before]
        return np.log10(p)


def fit(docs: DataFrame, learn: Column, order: int = ORDER, range_tokens: int = RANGE_TOKENS) -> Model:
    """The model of the texts of docs(doc_id, text) for which ``learn`` (of doc_id) holds."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    folder = f"{_local(shared_dir(spark))}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, True)
    rows = docs.where(learn).select(F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = max(1, -(-((size[0] or 0) // 6 + size[1]) // range_tokens))
    model = Model(folder, order, ranges, discounts=[discounts([0] * 4)] * order)
    dealt = lambda shipped: shipped.repartitionById(ranges, F.col("range"))
    for r in gathered(dealt(rows.mapInArrow(_ship_words(ranges), _BLOCKS)).mapInArrow(_write_words(folder), "range int, size long, tokens long")):
        model.tokens += r["tokens"]
        model.types += r["size"]
        model.bound = max(model.bound, r["size"] * ranges)
        model.held.setdefault(0, np.zeros(ranges, bool))[r["range"]] = True
    if not size[1]:
        return model

    def held_by(written: DataFrame) -> np.ndarray:
        out = np.zeros(ranges, bool)
        out[[r["range"] for r in gathered(written)]] = True
        return out

    model.held[order] = held_by(dealt(rows.mapInArrow(_ship_grams(model), _BLOCKS)).mapInArrow(_write_top(folder, order, ranges), "range long"))
    for level in range(order - 1, 0, -1):
        model.held[level] = held_by(spark.range(0, ranges, 1, ranges).mapInArrow(_write_lower(folder, level, ranges, model.held[level + 1]), "range long"))
        for name in os.listdir(folder):
            if name.startswith((f"told-{level}-", f"ends-{level}-")):
                os.remove(f"{folder}/{name}")
    for level in range(1, order + 1):
        sums = np.sum([np.load(f"{folder}/sums-{level}-{r:06d}.npy") for r in np.flatnonzero(model.held[level])], axis=0)
        model.discounts[level - 1] = discounts(sums[1:5].tolist())
        if level == 1:
            model.followed = int(sums[0])
            model.rest = float(np.dot(sums[[1, 2, 5]], model.discounts[0]) / sums[0])
    return model


def _score(model: Model):
    def block(batch, off, data):
        hashes, per = word_hashes(off, data)
        number, count = model.numbers(hashes)
        ends = np.concatenate([[0], np.cumsum(per)])
        base = segment_sum(np.log10((count + 1) / (model.tokens + 1 * (model.types + 1))), ends)
        cols = [pa.array(per, pa.int64()), pa.array(segment_sum(count > 0, ends), pa.int64()), pa.array(np.full(len(per), model.tokens), pa.int64())]
        cols += [pa.array(base), pa.array(segment_sum(model.log10(number, per), ends))]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_blocks(block, most=_BLOCK_BYTES)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
