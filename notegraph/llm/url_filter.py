"""URL verdicts: rules first, then naive Bayes over words that a unigram Viterbi finds in host and path.

Host and path are cut into runs of letters; a run of digits is the token ``#``. Each different
run is split into the words of the greatest product of unigram shares, counted over the words of all pages, the
runs that urls themselves set apart by a hyphen or digit, and the seeds; a stretch of n unknown letters has the
share 10 / (words * 10^n). For this every substring of a run meets the word counts by a join: a run
carries only the words it may contain, and no vocabulary is sent to anyone.

Labels come from the seeds, words of unwanted trades: a url that holds one is an example of what to
block, others of what to allow. The multinomial model counts each different url once, with digits
masked, so that a host that owns a third of all pages weighs by its different urls; shares are
smoothed towards those of all urls (``SMOOTHING`` tokens), so that words of either class that are rare say
little. As the log-odds of a url are a sum over its runs, runs are scored once each and the sums go to pages.

A rule ``host/path`` fits its host and all hosts below it if the url's path starts with the rule's;
the longest decides. Where none fits, a url is blocked if its log-odds are above zero.

Edge cases: a null url, or one without ``://``, has an empty host and path, no tokens and the prior's verdict: allow, unless most
urls are to be blocked. Runs of over 63 letters, which no host name has, are words as they are, so that
very long urls stay cheap. Ties between splits go to the shorter last word. Rows that repeat are judged alike. Empty tables give empty
results. Columns named host, path, rule, verdict or block_odds are replaced, others left alone.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import packed, stored

LONGEST_WORD, LONGEST_RUN, SMOOTHING = 20, 63, 10.0
#: Words of trades that filters commonly refuse.
SEEDS = (
    "adult ads adserver bet bets betting bingo blackjack bookmaker camgirl casino cialis clickbait escort fetish gambling hentai jackpot keygen levitra "
    "lottery malware milf nude payday phishing pills poker popup porn porno roulette sex sexy slots spam spyware torrent tracker viagra warez xxx"
).split()
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path of their urls."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, _UPPER, _UPPER.lower()), "path": path})


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of host and path by rules (verdict, host, path), the longest that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


# ------------------------------------------------------------------ segmentation


def best_split(run: str, shares: dict[str, float], unknown: float) -> list[str]:
    """The words of run whose log shares sum to the most; n unknown letters have unknown - n * ln 10."""
    if len(run) > LONGEST_RUN or run == "#":
        return [run]
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for begin in range(end - 1, -1, -1):
            word = run[begin:end]
            score = best[begin] + shares.get(word, unknown - len(word) * math.log(10))
            if score > best[end] + 1e-12:
                best[end], back[end] = score, begin
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def word_counts(urls: DataFrame, texts: DataFrame | None, seeds: list[str]) -> DataFrame:
    """(word, n) over texts(html), what urls(host, shape) set apart, and the seeds."""
    spark = urls.sparkSession
    # a label or name of several runs sets them apart
    names = urls.select(F.explode(F.split(F.lower(F.concat_ws("/", "host", "shape")), r"[^\p{L}#_-]+")).alias("name")).distinct()
    runs = names.select(F.regexp_extract_all("name", F.lit(r"(\p{L}+|[#_-]+)"), F.lit(1)).alias("runs")).where("size(runs) > 1").select(F.explode("runs").alias("word"))
    found = runs.where(r"word rlike '^\\p{L}'").groupBy("word").agg(F.count("*").alias("n"))
    found = found.unionByName(spark.createDataFrame([(w, 1) for w in seeds], "word string, n long"))
    if texts is not None:
        plain = F.lower(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), "<[^>]*>", " "))
        words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        found = found.unionByName(words)
    return found.where(f"length(word) BETWEEN 1 AND {LONGEST_WORD}").groupBy("word").agg(F.sum("n").alias("n"))


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of the different runs(run)."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    begins = F.expr(f"explode(flatten(transform(sequence(1, length(run)), b -> transform(sequence(1, least({LONGEST_WORD}, length(run) - b + 1)), n -> substr(run, b, n)))))")
    within = runs.where(f"length(run) <= {LONGEST_RUN}").select("run", begins.alias("word")).distinct()
    share = F.log(F.col("n") / F.lit(float(total)))
    held = within.join(counts, "word").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", share))).alias("shares"))
    unknown, schema = math.log(10 / total), pa.schema([("run", pa.string()), ("words", pa.list_(pa.string()))])

    def split(batches):
        for batch in batches:
            rows = [{"run": r, "words": best_split(r, dict(s or ()), unknown)} for r, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return runs.join(held, "run", "left").select("run", "shares").mapInArrow(split, "run string, words array<string>")


# ------------------------------------------------------------------------ model


def scored_urls(urls: DataFrame, texts: DataFrame | None, seeds: list[str] = SEEDS, smoothing: float = SMOOTHING) -> DataFrame:
    """(u1, u2, block_odds) of different urls(u1, u2, host, shape)."""
    seeds = list(dict.fromkeys(seeds))
    own = urls.select("u1", "u2", F.explode(F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "shape")), F.lit(r"(\p{L}+|#)"), F.lit(1))).alias("run")).groupBy("u1", "u2", "run").agg(F.count("*").alias("k"))
    own = stored(own)
    counts = stored(word_counts(urls, texts, seeds))
    runs = stored(segmented(own.select("run").distinct(), counts).withColumn("seeded", F.arrays_overlap("words", F.array(*map(F.lit, seeds)))))
    met = own.join(runs.select("run", "seeded"), "run")
    label = met.groupBy("u1", "u2").agg(F.max("seeded").alias("bad"))
    label = stored(label)
    # each run's uses in either class, then each word's
    uses = met.join(label, ["u1", "u2"]).groupBy("run").agg(F.sum(F.when(F.col("bad"), F.col("k")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("k"))).alias("good"))
    words = runs.join(uses, "run").select("run", F.explode("words").alias("word"), "bad", "good")
    table = stored(words.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    total, n_bad = table.agg(F.sum("bad"), F.sum("good")).first(), label.where("bad").count()
    bad, good = float(total[0] or 0), float(total[1] or 0)
    prior = math.log((n_bad + 1) / (urls.count() - n_bad + 1))
    share = (F.col("bad") + F.col("good")) / F.lit(max(1.0, bad + good)) * smoothing
    odds = F.log((F.col("bad") + share) / F.lit(bad + smoothing)) - F.log((F.col("good") + share) / F.lit(good + smoothing))
    of_run = runs.select("run", F.explode("words").alias("word")).join(table.select("word", odds.alias("odds")), "word").groupBy("run").agg(F.sum("odds").alias("odds"))
    told = own.join(of_run, "run").groupBy("u1", "u2").agg((F.sum(F.col("odds") * F.col("k")) + F.lit(prior)).alias("block_odds"))
    return urls.select("u1", "u2").join(told, ["u1", "u2"], "left").select("u1", "u2", F.coalesce("block_odds", F.lit(prior)).alias("block_odds"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", texts: DataFrame | None = None, seeds: list[str] = SEEDS) -> DataFrame:
    """pages with host, path, rule, block_odds and verdict (allow or block) of their urls; the words of texts(html) are counted."""
    parts = with_parts(packed(pages, url).withColumnRenamed(url, "_url"), "_url")
    shape = F.regexp_replace("path", "[0-9]+", "#")
    masked = F.regexp_replace("host", "[0-9]+", "#")
    keyed = parts.select("_row", "host", "path", shape.alias("shape"), F.xxhash64(masked, shape).alias("u1"), F.xxhash64(F.lit("url"), masked, shape).alias("u2"))
    urls = keyed.select("u1", "u2", F.regexp_replace("host", "[0-9]+", "#").alias("host"), "shape").dropDuplicates(["u1", "u2"])
    # stored, so that the join below meets two plain exchanges, of which Spark can split what one url fills
    odds = stored(scored_urls(stored(urls), texts, seeds))
    rule, said = rule_of(rules)
    verdict = F.coalesce(said, F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    new = {"host": F.col("host"), "path": F.col("path"), "rule": rule, "verdict": verdict, "block_odds": F.col("block_odds")}
    others = [F.col("_row")[c].alias(c) for c in pages.columns if c not in new]
    return keyed.drop("shape").join(odds, ["u1", "u2"], "left").select(*others, *(c.alias(n) for n, c in new.items()))
