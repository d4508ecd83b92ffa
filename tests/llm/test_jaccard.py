"""Near-duplicates by Jaccard similarity against all pairs of texts."""

import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from notegraph.llm import common, jaccard, simhash

from . import brute


def plain_groups(rows):
    """The least doc_id of each text's component of all pairs of five-word Jaccard >= 0.8."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = [i for i, _ in rows]
    near = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    return brute.components(ids, [(a, b) for a in ids for b in ids if a < b and near(sets[a], sets[b])])


def edited(rng, n, times):
    out = [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    for _ in range(times):
        out[rng.randrange(n)] = f"e{rng.randint(0, 9999)}"
    return out


def test_near_duplicates_against_all_pairs(spark):
    common.ship(spark)
    rng = random.Random(11)
    rows = [(9000, None), (9001, ""), (9002, " \n"), (9003, "two words"), (9004, "Two  words"), (9005, "four words in all")]
    for g in range(40):
        base = edited(rng, rng.choice([12, 60, 250, 400]), 0)
        for c in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9999)}"
            rows.append((g * 10 + c, " ".join(copy)))
    # One bucket of many near copies that are not all alike.
    base = edited(rng, 300, 0)
    for c in range(120):
        copy = list(base)
        for _ in range(rng.choice([0, 2, 6, 9])):
            copy[rng.randrange(300)] = f"e{rng.randint(0, 99999)}"
        rows.append((2000 + c, " ".join(copy)))
    want = plain_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(df).collect())
    assert kept == sorted({min(i for i in want if want[i] == c) for c in set(want.values())})
    # What the stage did before leaves near copies in.
    assert simhash.drop_near_duplicates(df).count() > len(kept)
    assert jaccard.drop_near_duplicates(df.limit(0)).count() == 0


def test_blocks_join_what_all_pairs_join(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(jaccard, "_COLUMNS", 64)
    for _ in range(40):
        base = [rng.randrange(1 << 60) for _ in range(40)]
        sets = []
        for _ in range(rng.randint(2, 30)):
            sets.append(np.unique(np.array([x if rng.random() > rng.choice([0, 0.05, 0.1, 0.3]) else rng.randrange(1 << 60) for x in base], np.uint64)))
        label = np.array([rng.randrange(rng.choice([1, 3, 30])) for _ in sets])
        near = lambda x, y: 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
        every = [(int(label[i]), int(label[j])) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
        got = [(int(label[i]), int(label[j])) for i, j in jaccard.joined(label, sets)]
        assert brute.components(set(label.tolist()), got) == brute.components(set(label.tolist()), every)


def test_the_stage_drops_a_near_copy_of_distant_fingerprint(spark):
    import corpus_pipeline

    rng = random.Random(3)
    base = edited(rng, 200, 0)
    while True:
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(200)] = f"e{rng.randint(0, 9999)}"
        a, b = " ".join(base), " ".join(copy)
        if len({*plain_groups([(1, a), (2, b)]).values()}) == 1 and (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 4:
            break
    docs = spark.createDataFrame([(1, a), (2, b), (3, "something else altogether, by far")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, "").collect()) == [1, 3]


def test_tiles_of_long_sets_are_bounded_in_bytes(spark):
    """2,000 sets of 20,000 shingles in one bucket: no tile holds more than three times a half's bytes, and every two nodes meet."""
    common.ship(spark)
    open_ = spark.range(2000).select(F.lit(1).alias("key"), F.xxhash64("id").alias("node"), F.lit(20_000).alias("n"), F.col("id").alias("label"))
    dealt = jaccard._dealt(open_)
    assert dealt.groupBy("key", "i", "j").agg((F.sum("n") * 8).alias("b")).agg(F.max("b")).first()[0] <= 3 * jaccard.TILE_BYTES
    halves = dealt.select("i").union(dealt.select("j")).distinct().count()
    assert dealt.select("i", "j").distinct().count() == halves * (halves + 1) // 2
    code = """
import resource, numpy as np
from notegraph.llm import jaccard
rng = np.random.default_rng(1)
base = rng.integers(0, 2**63, 21_000, dtype=np.uint64)
sets = [np.unique(np.where(rng.random(20_000) < 0.3, rng.integers(0, 2**63, 20_000, dtype=np.uint64), base[:20_000])) for _ in range(3 * jaccard.TILE_BYTES // 160_000)]
assert jaccard.joined(np.arange(len(sets)), sets) == [] and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_200_000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_small_tiles_join_the_same(spark, monkeypatch):
    rng = random.Random(5)
    base = edited(rng, 60, 0)
    rows = []
    for c in range(90):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(60)] = f"e{rng.randint(0, 99999)}"
        rows.append((c, " ".join(copy)))
    monkeypatch.setattr(jaccard, "TILE_BYTES", 2000)
    common.ship(spark)
    want = plain_groups(rows)
    kept = sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted({min(i for i in want if want[i] == c) for c in set(want.values())})


def test_tables_of_earlier_stages_go(spark):
    kept = common.stored(spark.range(3))
    with common.tables_let_go(spark) as settle:
        began = len(common._tables)
        a = settle(common.stored(spark.range(5)).where("id > 0"))
        b = settle(common.stored(a).where("id > 1"))
        assert len(common._tables) == began + 1 and b.count() == 3
    assert kept.count() == 3
