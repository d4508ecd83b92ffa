"""Dense search by cells against the exact one."""

import numpy as np
from pyspark.sql import functions as F

from notegraph.operators import cells, search
from notegraph.sources import tables

KIND = "vec_id long, name string, embedding array<double>"


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    return centres[rng.integers(0, 40, n)] + rng.normal(scale=0.4, size=(n, 16))


def test_recall_against_the_exact_search(spark, tmp_path):
    drawn = clustered(3060)
    rows = [(i, f"n{i // 2}", v.tolist()) for i, v in enumerate(drawn[:3000])]
    vectors = spark.createDataFrame(rows, KIND).repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn[3000:])], "query_id long, embedding array<double>")
    stored, exact = cells.write(vectors, str(tmp_path / "cells")), search.dense_search(vectors, queries)
    assert len(stored.centroids) == 55 and stored.vectors.count() == 3000 and stored.vectors.select("cell").distinct().count() > 30
    found = cells.dense_search(stored, queries)
    share = cells.recall(found, exact)
    assert share >= 0.9 and stored.probes < 28, (share, stored.probes)
    # what is found has its true score, and with all cells opened nothing is missed
    true = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    assert all(true.get((r.query_id, r.vec_id), r.score) == r.score for r in found.collect())
    order = lambda df: [tuple(r) for r in df.select("query_id", "rank", "vec_id", "name", "score").orderBy("query_id", "rank").collect()]
    assert order(cells.dense_search(stored, queries, probes=55)) == order(exact)


def test_recall_on_the_embeddings(spark, tmp_path):
    e = tables.table(spark, "/root/testdata/sf0.1", "embeddings")
    names = e.columns
    vectors = e.select(F.col(names[0]).cast("long").alias("vec_id"), F.col(names[0]).cast("string").alias("name"), F.col(next(n for n, t in e.dtypes if t.startswith("array"))).cast("array<double>").alias("embedding"))
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    stored = cells.write(vectors, str(tmp_path / "cells"))
    assert cells.recall(cells.dense_search(stored, queries), search.dense_search(vectors, queries)) >= 0.9


def test_only_opened_cells_are_read_and_empty_tables(spark, tmp_path):
    vectors = spark.createDataFrame([(i, str(i), [float(i % 4 == j) for j in range(4)]) for i in range(40)], KIND)
    stored = cells.write(vectors, str(tmp_path / "a"), cells=4)
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    found = cells.dense_search(stored, q, k=3, probes=1)
    assert {r.vec_id % 4 for r in found.collect()} == {0}
    scan = stored.vectors.where("cell IN (1)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in scan or "PartitionFilters: [(cell" in scan
    assert cells.dense_search(stored, q.limit(0)).collect() == []
    assert cells.dense_search(cells.write(vectors.limit(0), str(tmp_path / "b")), q).collect() == []
