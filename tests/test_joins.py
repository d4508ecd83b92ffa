"""Joins by similarity and by substring, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.operators import setjoin, substrings


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def sets(rng, n, words, most):
    return [(i, sorted(set(int(rng.paretovariate(0.6)) % words for _ in range(rng.randint(0, most))))) for i in range(n)]


@pytest.mark.parametrize(("t", "words", "most", "block"), [(0.15, 400, 60, 1 << 19), (0.35, 4000, 30, 700), (0.8, 60, 12, 100), (1.0, 9, 5, 50)])
def test_near_sets_against_all_pairs(spark, t, words, most, block):
    rng = random.Random(words)
    left, right = sets(rng, 90, words, most), sets(rng, 120, words, most) + [(120, None), (121, [1, 2, 3])]
    schema = "id long, x array<long>"
    batch = spark.createDataFrame(left, schema).withColumn("y", F.col("x"))
    table = spark.createDataFrame(right, schema).repartition(5).withColumn("y", F.expr("filter(x, e -> e % 2 = 0)"))
    want = {(i, j): (len({*a} & {*b}), len(a), len(b), len({e for e in b if e % 2 == 0} & {*a})) for i, a in left for j, b in right if b and jaccard({*a}, {*b}) >= t}
    pairs = setjoin.near_sets(batch, table, {"x": t}, ("y",), block=block)
    rows = pairs.collect()
    assert len(rows) == len(want) and {(r.a, r.b): (r.x_shared, r.x_a, r.x_b, r.y_shared) for r in rows} == want
    assert all(abs(r.j - jaccard({*dict(left)[r.a]}, {*dict(right)[r.b]})) < 1e-12 for r in pairs.select("a", "b", setjoin.jaccard_of("x").alias("j")).collect())
    best = setjoin.near_sets(batch, table, {"x": t}, best=True, block=block).groupBy("a").agg(F.max("x_near").alias("n")).collect()
    assert {r.a: round(r.n, 12) for r in best} == {i: round(max(jaccard({*dict(left)[i]}, {*b}) for (a, j), _ in want.items() if a == i for b in [dict(right)[j]]), 12) for i in {a for a, _ in want}}


def test_any_of_two_features_makes_a_pair(spark):
    df = spark.createDataFrame([("p", [1, 2], [9]), ("q", [3], [7, 8])], "id string, x array<long>, y array<long>")
    table = spark.createDataFrame([("r", [1, 2], [5]), ("s", [4], [7, 8]), ("t", [6], [6]), ("u", [], [])], df.schema)
    got = setjoin.near_sets(df, table, {"x": 0.5, "y": 0.5}).collect()
    assert sorted((r.a, r.b, r.x_shared, r.y_shared) for r in got) == [("p", "r", 2, 0), ("q", "s", 0, 2)]
    assert setjoin.near_sets(df.limit(0), table, {"x": 0.5}).collect() == [] and setjoin.near_sets(df, table.limit(0), {"x": 0.5}).collect() == []


def test_prefixes_leave_rare_partners_only():
    """Two sets that share only items that all sets have are not even candidates."""
    common = list(range(8))
    lists = [common + list(range(100 * k, 100 * k + 24)) for k in range(1, 50)]
    offsets = np.cumsum([0] + [len(x) for x in lists])
    index = setjoin.Index(offsets, np.array(sum(lists, [])), 0.6)
    ranks = index.ranks_of(np.array(sorted(lists[4])))
    assert index.candidates(ranks, 32).tolist() == [4]


@pytest.mark.parametrize("block", [1 << 20, 9])
def test_contained_against_all_pairs(spark, block):
    rng = random.Random(block)
    word = lambda most: "".join(rng.choice("abé") for _ in range(rng.randint(0, most)))
    needles = [(i, word(4)) for i in range(60)] + [(60, "a" * 40), (61, None), (62, "xyz"), (63, "aa"), (64, "aa")]
    hay = [(i, word(30)) for i in range(80)] + [(80, None), (81, ""), (82, "a" * 100_000), (83, "\U0001f600xyz\n")]
    n = spark.createDataFrame(needles, "k long, s string").select(F.struct("k").alias("n"), "s")
    h = spark.createDataFrame(hay, "h long, t string").repartition(3)
    got = [(r.n.k, r.h) for r in substrings.contained(n, h, block).collect()]
    want = [(i, j) for i, s in needles for j, t in hay if s and t and s in t]
    assert sorted(got) == sorted(want) and (60, 82) in want
    assert substrings.contained(n.limit(0), h).collect() == [] and substrings.contained(n, h.limit(0)).collect() == []


def test_a_pass_is_linear_in_a_long_text():
    import resource
    import time

    finder = substrings.Finder(["a" * k for k in (1, 2, 5, 50)] + ["never"])
    finder.within("warm")
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert len(finder.within("a" * 100_000)) == 4
    assert time.time() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 20_000
