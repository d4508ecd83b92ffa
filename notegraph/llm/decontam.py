"""Benchmark decontamination with suffix arrays over the training side.

Every shard (a sub-block of texts) gets a suffix array over its
words: positions sorted by their next words, found by prefix doubling of ranks. Every
suffix of every benchmark item is then binary-searched in each shard's array; what
shares at least a window of words with it is a verbatim match, which is extended to
its longest form and reported with its location. A training suffix that leaves the
benchmark's word pairs before a window is full can match none, so only the others
enter the array; that changes no result. Windows that are equal, in one item or in many, are one query, so that
what is found grows with the words of the texts and not with how often the benchmark repeats itself.

The benchmark is the stated query set. It goes to the workers in blocks of at most
``block_bytes`` of text (a longer item is a block of its own), which are read one after
the other, so that the driver never holds more than one. Benchmarks of one block, the
usual case, take one pass and no shuffle. Of each block of a larger one the matches are
stored, one row a text and match, and put together by text.

Edge cases: null or word-less texts have no words and are never contaminated; null
items match nothing. A very long text is a shard of its own. An item of fewer than
``window`` words is one window of its own length. Items that repeat in text (a tie) are
all listed in ``items``, and the first one's places in ``matches``; an item whose id is null still hits but has no id to
list. Rows of documents that repeat are judged row by row. Empty tables give empty
results, and an empty benchmark contaminates nothing. ``find_matches`` puts its columns
over those of their names and leaves others alone; ``drop_contaminated`` passes all
columns through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import LOWER, Roller, kept_rows, map_blocks, mix, packed, stored, text_buffers, words

WINDOW = 10
BLOCK_BYTES = 8 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = True
_IS_WORD[0x61:0x7B] = True
_IS_WORD[0x80:] = True


def _word_hashes(roller: Roller, data: np.ndarray, off: np.ndarray):
    low = LOWER[data]
    start, end, per = words(low, off, _IS_WORD)
    return roller.spans(roller.prefix(low), start, end), per


class Items:
    """A block of benchmark items as word numbers, with the suffixes that are searched."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        self.roller = Roller(0)
        off, data = text_buffers(texts)
        hashes, per = _word_hashes(self.roller, data, off)
        self.vocab = np.unique(hashes)
        self.word = np.searchsorted(self.vocab, hashes).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(per)])
        starts, lengths, owner = [], [], []
        for i, n in enumerate(per):
            size = min(window, int(n))
            if size:
                s = np.arange(first[i], first[i + 1] - size + 1)
                starts.append(s)
                lengths.append(np.full(len(s), size))
                owner.append(np.full(len(s), i))
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.first, self.ids = first, pa.array(ids, pa.int64())
        self.start, self.length, self.owner = cat(starts), cat(lengths), cat(owner)
        self._windows_once()
        v = max(len(self.vocab), 1)
        inside = np.ones(max(len(self.word) - 1, 0), bool)
        inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(self.word))] - 1] = False
        self.pairs = np.unique((self.word[:-1] * v + self.word[1:])[inside])
        self.v = v
        self.width = int(self.length.max()) if len(self.length) else 1
        self.shortest = int(self.length.min()) if len(self.length) else 1 << 60

    def _windows_once(self) -> None:
        """Equal windows become one query, at its first place; ``holders`` lists the items of each."""
        name, live = self.length.astype(np.uint64), np.ones(len(self.start), bool)
        for j in range(int(self.length.max()) if len(self.length) else 0):
            live = self.length > j
            name[live] = mix(name[live] * np.uint64(0x9E3779B97F4A7C15) + self.word[self.start[live] + j].astype(np.uint64))
        _, place, of = np.unique(name, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([of, self.owner], 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.holders = np.searchsorted(pairs[:, 0], np.arange(len(place) + 1)), pairs[:, 1]
        self.start, self.length, self.owner = self.start[place], self.length[place], self.owner[place]

    def ids_of(self, queries: np.ndarray) -> np.ndarray:
        """The ids, without null, of all items that hold any of the windows."""
        offsets, owner = self.holders
        held = np.unique(np.concatenate([owner[offsets[q] : offsets[q + 1]] for q in queries])) if len(queries) else np.zeros(0, np.int64)
        return np.unique(self.ids.take(pa.array(held)).drop_null().to_numpy(zero_copy_only=False))


class Shard:
    """Suffix array of a block of texts over the benchmark's vocabulary.

    Only runs of words that could hold a window enter it: maximal sequences in which
    every two neighbours are neighbours somewhere in the benchmark, of at least the
    shortest window's length. Between runs stands a word of no text, ``-1``.
    """

    def __init__(self, items: Items, data: np.ndarray, off: np.ndarray):
        hashes, self.per = _word_hashes(items.roller, data, off)
        self.first = np.concatenate([[0], np.cumsum(self.per)])
        n = len(hashes)
        self.n = n
        word = np.full(n + 1, -1, np.int64)
        if n and len(items.vocab):
            at = np.minimum(np.searchsorted(items.vocab, hashes), len(items.vocab) - 1)
            word[:n] = np.where(items.vocab[at] == hashes, at, -1)
        keep = word[:n] >= 0
        link = np.zeros(n + 1, bool)  # whether word i and word i + 1 follow each other in the benchmark
        if n and len(items.pairs):
            near = keep.copy()
            near[:-1] &= keep[1:]
            near[-1] = False
            ends = self.first[1:][self.per > 0] - 1
            near[ends] = False
            cand = np.flatnonzero(near)
            pair = word[cand] * items.v + word[cand + 1]
            k = np.minimum(np.searchsorted(items.pairs, pair), len(items.pairs) - 1)
            link[cand[items.pairs[k] == pair]] = True
        begins = np.flatnonzero(keep & ~np.concatenate([[False], link[: n - 1]])) if n else np.zeros(0, np.int64)
        last = np.flatnonzero(keep & ~link[:n])
        long = last - begins + 1 >= items.shortest
        sizes = (last - begins + 1)[long]
        runs = np.repeat(begins[long] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, np.int64)
        kept = runs + np.arange(len(runs))
        slot = np.arange(len(kept)) + np.repeat(np.arange(len(sizes)), sizes)
        total = len(kept) + len(sizes) + items.width + 1
        self.word = np.full(total, -1, np.int64)
        self.word[slot] = word[kept]
        self.origin = np.full(total, -1, np.int64)
        self.origin[slot] = kept
        self.suffixes = self._sorted(slot, items.width)

    def _sorted(self, slots: np.ndarray, width: int) -> np.ndarray:
        """All suffixes by their next ``width`` words at least: ranks of 1, 2, 4, … words, doubled while any tie."""
        rank, reach = self.word + 1, 1
        while reach < width:
            second = np.zeros(len(rank), np.int64)
            second[: len(rank) - reach] = rank[reach:]
            pairs = np.where(rank > 0, rank * (int(rank.max()) + 1) + second, 0)
            distinct, rank = np.unique(pairs, return_inverse=True)
            reach *= 2
            if len(distinct) > len(slots):  # no two suffixes tie
                break
        return slots[np.argsort(rank[slots], kind="stable")]

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of every occurrence of every query's window, by binary search."""
        sa = self.suffixes
        if not len(sa) or not len(items.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = np.zeros(len(items.start), np.int64)
        hi = lo.copy()
        for upper, out in ((False, lo), (True, hi)):
            left, right = np.zeros(len(lo), np.int64), np.full(len(lo), len(sa))
            while (open_ := left < right).any():
                mid = (left + right) // 2
                less = self._before(items, sa[np.minimum(mid, len(sa) - 1)], upper)
                left = np.where(open_ & less, mid + 1, left)
                right = np.where(open_ & ~less, mid, right)
            out[:] = left
        count = hi - lo
        query = np.repeat(np.arange(len(lo)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return query, sa[np.repeat(lo, count) + step]

    def _before(self, items: Items, pos: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix at pos sorts before each query's window (or starts with it)."""
        result = np.zeros(len(pos), np.int8)
        for j in range(items.width):
            live = (result == 0) & (items.length > j)
            if not live.any():
                break
            a, b = self.word[pos[live] + j], items.word[items.start[live] + j]
            result[live] = np.sign(a - b)
            # An unknown word ends a suffix; nothing after it is compared.
        return (result < 0) | (or_equal & (result == 0))


_MATCH = [("item", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]


def _extend(items: Items, query: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest matches at the windows' first places: each occurrence that the one before it does not already cover, with its full length."""
    diag = np.stack([items.owner[query], pos - items.start[query]], 1)
    order = np.lexsort((pos, diag[:, 1], diag[:, 0]))
    query, pos, diag = query[order], pos[order], diag[order]
    starts = np.ones(len(pos), bool)
    starts[1:] = (diag[1:] != diag[:-1]).any(1) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], len(pos)) - 1
    query, pos, length = query[at], pos[at], pos[ends] - pos[at] + items.length[query[ends]]
    order = np.lexsort((query, -length, pos))
    query, pos, length = query[order], pos[order], length[order]
    reach = np.maximum.accumulate(pos + length)
    longer = np.ones(len(pos), bool)
    longer[1:] = pos[1:] + length[1:] > reach[:-1]  # not within another
    return query[longer], pos[longer], length[longer]


def _lists(per: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), values)


def _judge(ids: list, texts: list, window: int):
    items = Items(ids, pa.array(texts, pa.string()), window)

    def block(batch, off, data):
        shard = Shard(items, data, off)
        query, pos = shard.search(items)
        n_docs = len(shard.per)
        pos = shard.origin[pos]
        delta = np.zeros(shard.n + 1, np.int64)
        np.add.at(delta, pos, 1)
        np.add.at(delta, pos + items.length[query], -1)
        hit = np.cumsum(delta)[: shard.n] > 0
        words_hit = np.concatenate([[0], np.cumsum(hit)])
        n_hit = words_hit[shard.first[1:]] - words_hit[shard.first[:-1]]
        of_doc = lambda at: np.searchsorted(shard.first, at, "right") - 1
        q, p, length = _extend(items, query, pos) if len(query) else (query, pos, pos)
        doc = of_doc(p)
        values = [items.ids.take(pa.array(items.owner[q])), pa.array(p - shard.first[doc]), pa.array(items.start[q] - items.first[items.owner[q]]), pa.array(length)]
        matches = _lists(np.bincount(doc, minlength=n_docs), pa.StructArray.from_arrays(values, fields=[pa.field(*f) for f in _MATCH]))
        met = np.unique(of_doc(pos) * len(items.start) + query) if len(query) else query  # a window once a text
        cuts = np.searchsorted(met, np.arange(n_docs + 1) * len(items.start))
        held = [items.ids_of(met[a:b] % len(items.start)) if a < b else () for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids_held = _lists(np.array([len(h) for h in held], np.int64), pa.array(np.concatenate([np.zeros(0, np.int64), *held]), pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(shard.per, pa.int64()), pa.array(n_hit, pa.int64()), matches, ids_held],
            names=[*batch.schema.names, "n_words", "n_hit", "matches", "items"],
        )

    return map_blocks(block)


class _Clean:
    """Whether each text of a block holds no window of any item. The items are numbered where they are used."""

    def __init__(self, *block):
        self.block, self.items = block, None

    def __call__(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        if self.items is None:
            ids, texts, window = self.block
            self.items = Items(ids, pa.array(texts, pa.string()), window)
        shard = Shard(self.items, data, off)
        pos = shard.origin[shard.search(self.items)[1]]
        return np.bincount(np.searchsorted(shard.first, pos, "right") - 1, minlength=len(shard.per)) == 0


_MATCHES_SQL = "array<struct<item:long,doc_word:long,item_word:long,n_words:long>>"
_OUT = f"n_words long, n_hit long, matches {_MATCHES_SQL}, items array<long>"


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded size, streamed partition by partition."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for r in rows.toLocalIterator():
        if texts and size + len(r[1].encode()) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
    yield ids, texts


def _text_name(text) -> list:
    held = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(held).alias("_k1"), F.xxhash64(F.lit("id"), held).alias("_k2")]


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: its columns (but those named as follows), n_words, n_hit, the longest verbatim matches of at least a window, and items.

    matches: item (id), doc_word and item_word (where they start), n_words; of items that share a window
    the first is named, at its first place, and what lies within another match is left out. items: the ids of
    all items of which a window occurs. With more than one block, hit words are counted from the union of all blocks' matches.
    """
    docs = docs.drop("n_words", "n_hit", "matches", "items")
    judged = lambda df, block: df.mapInArrow(_judge(*block, window), f"{_schema(df)}, {_OUT}")
    blocks = item_blocks(items, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return judged(docs, first)
    texts, found = docs.select("text"), None
    for block in chain((first, second), blocks):
        hits = judged(texts, block).where("n_hit > 0").select(*_text_name(F.col("text")), "matches", "items")
        one = stored(hits.dropDuplicates(["_k1", "_k2"]))
        found = one if found is None else found.unionAll(one)
    every = stored(found.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("matches")).alias("_m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_i")))
    counted = judged(docs, ([], [])).drop("n_hit", "matches", "items").select("*", *_text_name(F.col("text")))
    out = counted.join(every, ["_k1", "_k2"], "left")
    # the longest at each place first, then the least item
    order = F.array_sort(F.transform(F.coalesce("_m", F.array().cast(_MATCHES_SQL)), lambda m: F.struct(m["doc_word"].alias("s"), (-m["n_words"]).alias("n"), m["item"].alias("i"), m["item_word"].alias("w"))))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("at"), F.array().cast(_MATCHES_SQL).alias("kept"))
    told = lambda x: F.struct(x["i"].alias("item"), x["s"].alias("doc_word"), x["w"].alias("item_word"), (-x["n"]).alias("n_words"))

    def step(a, x):
        end = x["s"] - x["n"]
        return F.when(end <= a["at"], a).otherwise(F.struct((a["hit"] + end - F.greatest(x["s"], a["at"])).alias("hit"), end.alias("at"), F.concat(a["kept"], F.array(told(x))).alias("kept")))

    folded = out.withColumn("_f", F.aggregate(order, zero, step))
    return folded.select(*(folded[c] for c in docs.columns), "n_words", F.col("_f.hit").alias("n_hit"), F.col("_f.kept").alias("matches"), F.coalesce("_i", F.array().cast("array<long>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold any window of any item."""
    blocks = item_blocks(items, block_bytes)
    ids, texts = next(blocks)
    if next(blocks, None) is None:
        return kept_rows(docs, "text", _Clean(ids, texts, window))
    return find_matches(packed(docs, "text"), items, window, block_bytes).where("n_hit = 0").select("_row.*")


def digest(matched: DataFrame) -> DataFrame:
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return matched.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def oracle(window: int = WINDOW) -> str:
    """DuckDB's version of ``digest(find_matches(documents, benchmark))``, for doc_ids that are unique."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {found} AS w FROM documents),
b AS (SELECT item_id, {found} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least({window}, len(w)) AS n, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)"""
