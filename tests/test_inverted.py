"""Features counted in tasks against a row for each posting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.operators import index, inverted, search


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(3)
    odd = ["", " ", "a", "ab", "\x00ab", "ÄÖ ß İi Σς", "数据 模型数 的", "😀x 😀😀", "a_b  c\n\nd\te", "née ée", "x" * 50, "aaa aa a"]
    rows = [(i, s, s[::-1], [s]) for i, s in enumerate(odd)] + [(5, None, None, None), (-3, "minus three", "three", None), (5, "again 数据", "five", None), (5, "again 5", "x", [])]
    rows += [(100 + i, f"note {i}", " ".join(rng.choice(["kel", "mul", "数据 x", "tin tin", "É"]) for _ in range(9)), ["x"]) for i in range(300)]
    return spark.createDataFrame(rows, "note_ord long, name string, summary string, tags array<string>").repartition(5)


@pytest.mark.parametrize("size", [1, 90, 1 << 21])
def test_blocks_hold_every_posting_once(spark, notes, monkeypatch, size):
    monkeypatch.setattr(inverted, "SLICE", size)
    want = sorted(map(tuple, search.postings(notes).distinct().select("kind", "feature", "note_ord").collect()))
    at = inverted.blocks(notes, search.indexed_text(notes), 64).select("kind", "feature", "block", F.explode("places").alias("at"))
    assert sorted(map(tuple, at.select("kind", "feature", F.col("block") * 64 + F.col("at")).collect())) == want


def test_no_posting_is_a_row(spark, notes):
    """Of each slice a row a feature: notes of one text make no more rows than one of them."""
    same = spark.range(0, 500, 1, 3).select(F.col("id").alias("note_ord"), F.lit("one text of all").alias("name"), F.lit("graph engine").alias("summary"), F.lit(None).cast("array<string>").alias("tags"))
    one = search.postings(same.where("note_ord = 7")).count()
    assert inverted.blocks(same, search.indexed_text(same), index.BLOCK).count() == one


def test_counts_are_of_rows(spark, notes):
    want = search.postings(notes).groupBy("kind", "feature").count()
    got = search.feature_counts(notes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString(), "no posting is a row"


def test_pairs_of_wide_codes(spark):
    """Codes that leave no room for the owner beside them are ranked first."""
    rng = np.random.default_rng(4)
    code, owner = rng.choice([0, 1, 5, (1 << 62) - 1, (1 << 63) - 1], 400), rng.integers(0, 9, 400)
    known, at, of = inverted._pairs(code, owner, 9, 63)
    assert known.tolist() == sorted(set(code.tolist()))
    assert list(zip(known[at].tolist(), of.tolist())) == sorted(set(zip(code.tolist(), owner.tolist())))
