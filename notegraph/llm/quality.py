"""Quality rules: fixed text statistics, then a calibrated linear model on hashed n-grams.

The base rules are counts over whole texts. What passes them is judged by logistic
regression on the relative frequencies of hashed words and hashed character
four-grams, fitted on at most ``FIT_ROWS`` labelled rows (those of least hash, so the
choice depends on nothing but doc_id) and calibrated by Platt's method on a quarter
of them that the fit has not seen. Scores are made in Arrow batches, and a row stays
if its calibrated probability of being good reaches ``THRESHOLD``.

Edge cases: a null or empty text has no words, no symbols and no lines, and fails the
base rules, as any text under 20 words does. A very long text is a block of its own and
is judged whole. Rows that repeat are judged row by row; null ids are carried. A score
that equals the threshold (a tie) is kept. Labels that are null, or of ids that are not
there, are not used; of labels that disagree for one id the greatest counts. With no
labels, or of one value only, the base rules alone decide. An empty table gives an empty
result. ``judge`` puts its columns over those of their names; ``keep`` passes all columns
through, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import WHITE, Roller, kept_rows, map_blocks, mix, owners, segment_sum, text_buffers, words

FIT_ROWS = 4_000
THRESHOLD = 0.25
BUCKET_BITS = 15
GRAM = 4
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_STEPS = 120
_SCALE = 30.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


class Features:
    """What a block of texts holds: words, and buckets of words and character grams."""

    def __init__(self, off: np.ndarray, data: np.ndarray):
        self.off, self.data = off, data
        roller = Roller(0)
        self.roller, self.prefix = roller, roller.prefix(data)
        self.start, self.end, self.per = words(data, off, ~WHITE)
        self.word_off = np.concatenate([[0], np.cumsum(self.per)])
        self.hash = roller.spans(self.prefix, self.start, self.end)

    def word_buckets(self) -> np.ndarray:
        return (self.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def gram_buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all byte windows of GRAM, and each text's range of them."""
        grams = self.roller.windows(self.prefix, GRAM)
        bucket = (mix(grams) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (1 << BUCKET_BITS)
        last = np.minimum(np.maximum(self.off[1:] - GRAM + 1, self.off[:-1]), len(bucket))
        return bucket, np.stack([np.minimum(self.off[:-1], last), last], 1)


def _repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more with the same owner."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        name = keys ^ mix(owner.astype(np.uint64) + np.uint64(1))
        order = np.argsort(name, kind="stable")
        s = name[order]
        same = s[1:] == s[:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def base_counts(x: Features) -> dict[str, np.ndarray]:
    """The statistics of the base rules, for each text."""
    n_docs, data, off = len(x.per), x.data, x.off
    white = WHITE[data]
    chars = segment_sum(~white & ~_CONTINUES[data], off)
    symbols = segment_sum(_SYMBOL[data], off)
    # Lines: split at \n; a line counts if it has a word.
    owner_of = np.repeat(np.arange(n_docs), np.diff(off))
    breaks = np.flatnonzero(data == 10)
    full = off[:-1] < off[1:]
    starts = np.concatenate([off[:-1][full], breaks + 1])
    ends = np.concatenate([off[1:][full], breaks])
    line_owner = np.concatenate([np.flatnonzero(full), owner_of[breaks]]) if len(data) else np.zeros(0, np.int64)
    starts.sort()
    ends.sort()
    line_owner.sort()
    ends = np.minimum(np.maximum(ends, starts), off[1:][line_owner]) if len(starts) else ends
    solid = np.concatenate([[0], np.cumsum(~white)])
    wordy = solid[ends] > solid[starts] if len(starts) else np.zeros(0, bool)
    starts, ends, line_owner = starts[wordy], ends[wordy], line_owner[wordy]
    name = x.roller.spans(x.prefix, starts, ends) ^ mix(line_owner.astype(np.uint64) + np.uint64(1))
    first = np.zeros(len(name), bool)
    first[np.unique(name, return_index=True)[1]] = True
    dup_lines = np.bincount(line_owner[~first], minlength=n_docs)
    # Windows of words, as hashes of their words' hashes.
    n, k = len(x.hash), REPEAT_WINDOW
    doc = owners(x.per)
    repeat = np.zeros(n_docs, np.int64)
    if n >= k:
        window = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            window = window * np.uint64(0x9E3779B97F4A7C15) + x.hash[j : n - k + 1 + j]
        inside = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        twice = inside[_repeated(mix(window[inside]), doc[inside])]
        delta = np.zeros(n + 1, np.int64)
        delta[twice] += 1
        delta[twice + k] -= 1
        repeat = segment_sum(np.cumsum(delta)[:n] > 0, x.word_off)
    return {"n_words": x.per, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


class Model:
    """weights over both kinds of buckets, a bias, and Platt's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def scores(self, x: Features) -> np.ndarray:
        w = self.weights
        by_word = segment_sum(w[x.word_buckets()], x.word_off) / np.maximum(x.per, 1)
        bucket, span = x.gram_buckets()
        c = np.concatenate([[0.0], np.cumsum(w[bucket], dtype=np.float64)])
        by_gram = (c[span[:, 1]] - c[span[:, 0]]) / np.maximum(span[:, 1] - span[:, 0], 1)
        z = self.slope * (_SCALE * (by_word + by_gram) + self.bias) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _sparse(x: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, relative frequencies) of each text."""
    out, word, (gram, span) = [], x.word_buckets(), x.gram_buckets()
    for i in range(len(x.per)):
        parts = []
        for b in (word[x.word_off[i] : x.word_off[i + 1]], gram[span[i, 0] : span[i, 1]]):
            k, n = np.unique(b, return_counts=True)
            parts.append((k, n / max(len(b), 1)))
        out.append((np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([p[1] for p in parts]).astype(np.float32)))
    return out


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with Platt's smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def fit_rows(indices: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> Model:
    """Full-batch Adam on the logistic loss of the rows not held back, Platt on the others."""
    n = 2 << BUCKET_BITS
    sizes = np.array([len(i) for i in indices])
    row, col = np.repeat(np.arange(len(y)), sizes), np.concatenate(indices)
    val = np.concatenate(values) * np.float32(_SCALE)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    use = ~held if 0 < y[~held].sum() < (~held).sum() else np.ones(len(y), bool)
    balance = np.where(y > 0, 0.5 / max(y[use].mean(), 1e-9), 0.5 / max(1 - y[use].mean(), 1e-9)) * use / use.sum()
    w, bias, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)

    def margins():
        c = np.concatenate([[0.0], np.cumsum(w[col] * val)])
        return c[ends[1:]] - c[ends[:-1]] + bias

    for t in range(1, _STEPS + 1):
        err = (1 / (1 + np.exp(-np.clip(margins(), -500, 500))) - y) * balance
        g = np.append(np.bincount(col, val * err[row], n) + 1e-6 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    z = margins()
    on = held if 0 < y[held].sum() < held.sum() else use
    return Model(w, float(bias), *_platt(z[on], y[on]))


def _fit_features(batch, off, data):
    rows = _sparse(Features(off, data))
    cols = [pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([b.tobytes() for _, b in rows], pa.binary())]
    return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *cols], names=["label", "held", "buckets", "freqs"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", fit_rows_at_most: int = FIT_ROWS) -> Model | None:
    """A model from at most ``fit_rows_at_most`` labelled rows; None without both kinds."""
    marks = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(fit_rows_at_most)
    # At most fit_rows_at_most pairs of numbers, whatever the table's size.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "label", (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0).alias("held"))
    got = rows.mapInArrow(map_blocks(_fit_features), "label int, held boolean, buckets binary, freqs binary").toArrow()
    y = got.column("label").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    parse = lambda name, kind: [np.frombuffer(b.as_py(), kind) for b in got.column(name)]
    return fit_rows(parse("buckets", np.int32), parse("freqs", np.float32), y, got.column("held").to_numpy())


_KIND = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def _judge(model: Model | None, threshold: float):
    def block(batch, off, data):
        x = Features(off, data)
        c = base_counts(x)
        failed = base_failed(c)
        score = model.scores(x) if model else np.ones(len(x.per))
        cols = [pa.array(v, pa.int64()) for v in c.values()] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
        names = [*c, "base_failed", "quality_score", "kept"]
        return pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return map_blocks(block)


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base statistics, base_failed, quality_score and kept, over any columns of those names."""
    names = [part.split()[0] for part in _KIND.split(", ")]
    docs = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_judge(model, threshold), f"{schema}, {_KIND}")


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the rules or the model reject."""

    def verdict(off, data):
        x = Features(off, data)
        failed = base_failed(base_counts(x))
        return ~failed & (model.scores(x) >= threshold) if model else ~failed

    return kept_rows(docs, "text", verdict)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")
