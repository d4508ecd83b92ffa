"""Deduplication of sliding sentence spans.

Sentences end at a word that ends in ``.``, ``!`` or ``?``, or at a line's end. One of
more than ``MAX_WORDS`` words is cut further, where the content says so: of every run
of ``MAX_WORDS`` words inside it the word of least hash (the last of equal ones) begins
a new sentence. Cuts are thus never more than ``MAX_WORDS`` words apart, and a passage
that begins anywhere in a sentence has the same cuts in all its copies but within that
distance of its ends. From every sentence starts a span: the shortest run of at least
``MIN_SENTENCES`` sentences that has ``MIN_WORDS`` words. Spans are hashed over their
words, so spacing does not matter, and joined globally; of equal spans the first by
(doc_id, text, place) stays and the sentences of all others are removed.

Each span is one row of numbers. Equal spans are added up before the shuffle to one
row a task; the join back has a row a span on its other side, so a span that a third
of all texts share splits like any skewed join.

Edge cases: null, empty and short texts have no spans and stay as they are. A very long
text is a block of its own, and costs what many short ones of its size do. Texts that
share an id are told apart by what they hold, as are those without an id, which come
after all others. Rows that repeat (same id, same text) count as one text and share its
fate. Of equal spans in one text (a tie) the first stays. An empty table gives an empty
result. Columns other than doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import ROW_KEY, ROW_KEY_SCHEMA, WHITE, Roller, id_of, least_places, map_blocks, mix, owners, row_key, stored, words

MIN_SENTENCES = 2
MIN_WORDS = 20
MAX_WORDS = 12
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


class Sentences:
    """A block's sentences as ranges of words, and the spans that start at them."""

    def __init__(self, off: np.ndarray, data: np.ndarray, min_sentences: int, min_words: int, max_words: int):
        self.off = off
        start, end, per = words(data, off, ~WHITE)
        self.start, n = start, len(start)
        doc = owners(per)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        closes = np.ones(n, bool)
        if n:
            closes = _STOP[data[end - 1]]
            closes[:-1] |= (doc[1:] != doc[:-1]) | (lines[start[1:]] > lines[end[:-1]])
            closes[-1] = True
        opens = np.concatenate([[True], closes[:-1]]) if n else closes
        hashes = [r.spans(r.prefix(data), start, end) for r in (Roller(0), Roller(1))]
        if n > max_words:
            sentence = np.cumsum(opens) - 1
            long = np.bincount(sentence)[sentence] > max_words
            inside = np.flatnonzero(long[: n - max_words + 1] & (sentence[: n - max_words + 1] == sentence[max_words - 1 :]))
            opens[least_places(hashes[0], max_words)[inside]] = True
        self.first = np.flatnonzero(opens)
        self.doc = doc[self.first]
        self.begin = np.searchsorted(self.doc, np.arange(len(per) + 1))
        ends = np.append(self.first[1:], n)
        count = len(self.first)
        # The sentence that closes each span, and whether it is still in the text.
        enough = np.searchsorted(ends, self.first + min_words)
        closing = np.maximum(enough, np.arange(count) + min_sentences - 1)
        ok = closing < count
        ok[ok] = self.doc[closing[ok]] == self.doc[ok]
        self.at, self.closing = np.flatnonzero(ok), closing[ok]
        self.names = []
        for which in (0, 1):
            p, inv = Roller(which).powers(n + 1)
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[which] * p[:n], dtype=np.uint64)])
            a, b = self.first[self.at], ends[self.closing]
            self.names.append(mix((prefix[b] - prefix[a]) * inv[a] + (b - a).astype(np.uint64)))


def _spans(*shape: int):
    def block(batch, off, data):
        s = Sentences(off, data, *shape)
        if not len(s.at):
            return None
        take = pa.array(s.doc[s.at])
        ordinal = s.at - s.begin[s.doc[s.at]]
        cols = [*(batch.column(i).take(take) for i in range(3)), pa.array(ordinal.astype(np.int32))]
        cols += [pa.array(s.names[0].view(np.int64)), pa.array((s.names[1] >> np.uint64(32)).astype(np.uint32).view(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=[*ROW_KEY, "ordinal", "n1", "n2"])

    return map_blocks(block)


def _clean(*shape: int):
    def block(batch, off, data):
        s = Sentences(off, data, *shape)
        starts = np.append(s.start[s.first], 0)
        closing = dict(zip(s.at.tolist(), s.closing.tolist()))
        gone, total, texts = [], [], []
        for d, ordinals in enumerate(batch.column(4).to_pylist()):
            lo, hi = int(s.begin[d]), int(s.begin[d + 1])
            total.append(hi - lo)
            out = np.zeros(hi - lo, bool)
            for o in ordinals or []:
                out[o : closing[lo + o] + 1 - lo] = True
            gone.append(int(out.sum()))
            raw = data[off[d] : off[d + 1]]
            if out.any():
                edge = np.append(starts[lo:hi] - off[d], len(raw))
                keep = np.ones(len(raw), bool)
                for i in np.flatnonzero(out):
                    keep[edge[i] : edge[i + 1]] = False
                raw = raw[keep]
            texts.append(raw.tobytes())
        kept = pa.array(texts, pa.binary()).cast(pa.string())
        cols = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), kept]
        return pa.RecordBatch.from_arrays([batch.column(5), *cols], names=["doc_id", "n_sentences", "n_removed", "text"])

    return map_blocks(block)


def remove_repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_sentences, n_removed, text without the removed sentences."""
    shape = (min_sentences, min_words, max_words)
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = rows.mapInArrow(_spans(*shape), f"{ROW_KEY_SCHEMA}, ordinal int, n1 long, n2 int")
    place, name = F.struct(*ROW_KEY, "ordinal"), ["n1", "n2"]
    counted = spans.groupBy(*name).agg(F.min(place).alias("least"), F.max(place).alias("most"))
    repeated = stored(counted.where("least <> most").select(*name, "least"))
    later = stored(spans.join(repeated, name).where(place != F.col("least")).groupBy(*ROW_KEY).agg(F.collect_set("ordinal").alias("gone")))
    return (
        rows.join(later, ROW_KEY, "left").select(*ROW_KEY, "text", "gone", id_of(F.col("no_id"), F.col("id")).alias("doc_id"))
        .mapInArrow(_clean(*shape), "doc_id long, n_sentences long, n_removed long, text string")
    )


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
