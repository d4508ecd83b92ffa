"""Toxic passages as maximum-scoring segments over token log-odds.

Tokens (runs of letters and digits, lower case) and their prefixes of four to seven
letters get log-odds of occurring in toxic against other labelled texts, counted once
a text, under a Dirichlet prior proportional to the pooled counts. Those whose odds
are both large and significant keep their score; every other token has the (slightly
negative) log-odds of the rest. Ruzzo and Tompa's scan then finds all maximal segments
of a text in linear time. Segment scores follow an extreme-value law with the
parameter that makes the expected exponential score one; its scale is fitted on clean
texts. Each repeat of a token in a text scores half of the last. A text's evidence is the
sum of its segments' normalised scores above chance, turned into a probability by
Platt's method on labelled rows the counts have not seen; its passages are the same
segments, those that chance explains in fewer than ``SIGNIFICANT`` texts.

The counts use at most ``FIT_ROWS`` labelled rows (those of least hash of doc_id), of
which a quarter is held for calibration; the model holds every feature of those rows
that is significant. All texts are scored whole.

Edge cases: null and empty texts have no tokens and the score of no evidence. A very
long text is scanned once, in time linear in its tokens; its size raises the floor that
its segments must pass. Of segments that tie in score each counts for itself, and of
maximal ones that could be cut in two ways the scan keeps the longer. Rows that repeat
are scored row by row; a null doc_id counts as the empty text in the hash that holds
rows out. Labels that are null or without a document are not used; of labels that
disagree for one id the greatest counts. Without both kinds of labels every score is 0
(or 1, if all labels are toxic); an empty table gives an empty result. Columns other
than doc_id, text and the label are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import crc_mod, cut
from notegraph.llm.quality import _platt

FIT_ROWS = 20_000
PRIOR_SHARE = 0.05
MIN_Z = 2.6
MIN_LOG_ODDS = 1.0
SIGNIFICANT = 0.05
_TOKEN = re.compile(r"[^\W_]+")
_PREFIXES = (7, 6, 5, 4)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(token: str) -> list[str]:
    """The token, then its prefixes, longest first; a prefix is marked by a star."""
    return [token, *(token[:n] + "*" for n in _PREFIXES if len(token) >= n)]


class Model:
    def __init__(self, scores: dict[str, float], rest: float, lam: float, k: float, slope: float, offset: float):
        self.scores, self.rest, self.lam, self.k, self.slope, self.offset = scores, rest, lam, k, slope, offset
        self.known: dict[str, float] = {}

    def token_score(self, token: str) -> float:
        got = self.known.get(token)
        if got is None:
            got = next((self.scores[f] for f in features(token) if f in self.scores), 0.0)
            if len(self.known) >= 500_000:
                self.known.clear()
            self.known[token] = got
        return got

    def segments(self, toks: list[str]) -> list[tuple[float, int, int]]:
        scores = [self.token_score(t) for t in toks]
        if any(scores):
            seen: dict[str, float] = {}
            for i, t in enumerate(toks):
                if scores[i]:
                    share = seen.get(t, 1.0)
                    scores[i], seen[t] = scores[i] * share, share / 2
        return maximal_segments(scores, self.rest)

    def evidence(self, segments: list[tuple[float, int, int]], n_tokens: int) -> float:
        floor = math.log(max(self.k * n_tokens, 1e-12))
        return sum(max(0.0, self.lam * s - max(floor, 0.0)) for s, _, _ in segments)

    def significant(self, score: float, n_tokens: int) -> bool:
        return self.k * n_tokens * math.exp(-min(self.lam * score, 700.0)) < SIGNIFICANT

    def probability(self, evidence: float) -> float:
        z = self.slope * math.log1p(evidence) + self.offset
        return 1.0 / (1.0 + math.exp(-max(min(z, 500.0), -500.0)))


def maximal_segments(scores: list[float], rest: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, start, end); a zero stands for ``rest``, at most 0.

    Each candidate remembers the last earlier one that starts lower, so the search
    for it follows a chain and the whole scan is linear.
    """
    total, at, found = 0.0, 0, []  # found: (low, high, start, end, index of the last that starts lower)
    for i, s in enumerate(scores):
        if s == 0.0:
            continue
        total += rest * (i - at)
        at = i + 1
        low = total
        total += s
        if s < 0:
            continue
        high, start = total, i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, start, i + 1, j))
                break
            low, start, up = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = up
    return [(high - low, start, end) for low, high, start, end, _ in found]


def _count(batches):
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            (toxic if label else clean).update({f for t in set(tokens(text.as_py() or "")) for f in features(t)})
        names = list(toxic.keys() | clean.keys())
        cols = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (toxic, clean))]
        yield pa.RecordBatch.from_arrays(cols, names=["feature", "toxic", "clean"])


def _lambda(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p * exp(lambda * score) = 1, or 1 where the mean score is not negative."""
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 600))).sum()) - 1
    if (p * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _evidence(model: Model):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                toks = tokens(text.as_py() or "")
                segs = model.segments(toks)
                rows.append((len(toks), max((s for s, _, _ in segs), default=0.0), [s for s, _, _ in segs]))
            cols = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "n_tokens", "top", "segments"])

    return run


def one_of_each(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, label) with one row of those that share the least hash of their word 4-grams.

    Copies of one toxic text would else make each of its words look toxic.
    """
    word = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 3, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, 4)))
    held = rows.withColumn("_w", word).withColumn("_sign", F.array_min(grams))
    one = held.groupBy("_sign").agg(F.min_by(F.struct("doc_id", "text", "label"), "doc_id").alias("r"))
    return one.select("r.doc_id", "r.text", "r.label")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, column: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most ``fit_rows`` labelled rows for which ``learn`` (of doc_id) holds."""
    marks = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), column)
    marks = marks.where(learn).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(fit_rows)
    # At most fit_rows pairs of numbers, whatever the table's size.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = cut(one_of_each(rows))  # read three times below
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    counts = cut(
        rows.where(~held).select("label", "text").mapInArrow(_count, "feature string, toxic long, clean long")
        .groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    )
    # Prefix features overlap words; totals are over words alone.
    seen = {"t": 0, "c": 0} | {k: v or 0 for k, v in counts.where(~F.col("feature").endswith("*")).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first().asDict().items()}
    n_t, n_c = float(seen["t"]), float(seen["c"])
    if not n_t or not n_c:
        return Model({}, 0.0, 1.0, 1.0, 1.0, 500.0 if n_t else -500.0)
    prior = PRIOR_SHARE * (F.col("t") + F.col("c"))
    room = PRIOR_SHARE * (n_t + n_c)
    odds = F.log((F.col("t") + prior) / (n_t + room - F.col("t") - prior)) - F.log((F.col("c") + prior) / (n_c + room - F.col("c") - prior))
    z = odds / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    picked = (
        counts.withColumns({"odds": odds, "z": z}).where((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_LOG_ODDS))
        .select("feature", "odds", "t", "c").collect()
    )
    scores = {r.feature: r.odds for r in picked}
    # Mass of the scored tokens under either kind; the rest's log-odds follow from it.
    used = [(r.odds, (r.t + PRIOR_SHARE * (r.t + r.c)) / (n_t + room), (r.c + PRIOR_SHARE * (r.t + r.c)) / (n_c + room)) for r in picked if not r.feature.endswith("*")]
    q_t, q_c = min(sum(u[1] for u in used), 0.999), min(sum(u[2] for u in used), 0.999)
    rest = min(math.log((1 - q_t) / (1 - q_c)), -1e-3)
    s = np.array([u[0] for u in used] + [rest])
    lam = _lambda(s, np.array([u[2] for u in used] + [1 - q_c]))
    model = Model(scores, rest, lam, 1.0, 1.0, 0.0)
    got = rows.where(held).select("label", "text").mapInArrow(_evidence(model), "label int, n_tokens long, top double, segments array<double>").toArrow()
    y = got.column("label").to_numpy().astype(float)
    m = np.maximum(got.column("n_tokens").to_numpy(), 1)
    top = got.column("top").to_numpy()
    clean = y == 0
    if clean.any():
        # The scale's maximum likelihood, given the rate.
        model.k = float(clean.sum() / (m[clean] * np.exp(-np.minimum(lam * top[clean], 600))).sum())
    x = np.array([math.log1p(model.evidence([(v, 0, 0) for v in segs.as_py()], n)) for segs, n in zip(got.column("segments"), m.tolist())])
    if 0 < y.sum() < len(y):
        model.slope, model.offset = _platt(x, y)
    else:
        model.slope, model.offset = 2.0, -3.0
    return model


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score(model: Model):
    def run(batches):
        for batch in batches:
            score, passages = [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                toks = tokens(t)
                segments = model.segments(toks)
                score.append(model.probability(model.evidence(segments, len(toks))))
                found = [(s, a, b) for s, a, b in segments if model.significant(s, len(toks))]
                places = [m.span() for m in _TOKEN.finditer(t.lower())] if found else []
                passages.append([{"start": places[a][0], "end": places[b - 1][1], "score": s} for s, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(passages, _PASSAGES)], names=["doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, score, passages (of the lower-cased text, in code points)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_score(model), "doc_id long, score double, passages array<struct<start:long,end:long,score:double>>")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def digest(scored: DataFrame) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages")
    )
