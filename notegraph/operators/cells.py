"""Dense search at size: vectors stored by cell, of which a query opens its nearest ones.

The centroids of the cells are fitted by k-means on directions of a bounded sample, ``SAMPLE`` vectors chosen by the hash of their ids,
at most ``CELLS`` of them: no more reaches the driver, whatever the table's size. Every vector is then stored under its cell;
a cell that holds many is many files. How many cells a query opens is measured on the sample too: twice as many as hold ``TARGET`` of
true neighbours there, which are few where vectors cluster and nearly all where they don't. A query is compared with all vectors of these cells
exactly, by ``search.dense_search``'s rules, so that what it returns has true scores; what it can miss lies in cells that it
does not open. ``recall`` measures that against the exact search, which stays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.operators import search
from notegraph.operators.lineage import cut
from notegraph.shipping import ship

SAMPLE, CELLS, ROUNDS = 20_000, 1024, 12
TARGET, TRIED, NEIGHBOURS = 0.96, 256, 10


def _directions(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def probes_for(raw: np.ndarray, centroids: np.ndarray, cell: np.ndarray) -> int:
    """Cells to open: twice as many as hold ``TARGET`` of the nearest ones of some of the sample's vectors, as other queries may lie worse."""
    asked = raw[:TRIED]
    scores = asked @ raw.T
    np.fill_diagonal(scores, -np.inf)
    k = min(NEIGHBOURS, len(raw) - 1)
    if not k:
        return 1
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.empty((len(asked), len(centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None, :], axis=1)
    return min(len(centroids), 2 * (int(np.quantile(np.take_along_axis(place, cell[nearest], axis=1), TARGET, method="higher")) + 1))


def fit(vectors: DataFrame, cells: int | None = None) -> tuple[np.ndarray, int]:
    """(centroids, one a row: the square root of the vectors' number, unless ``cells`` says how many; cells to open)."""
    n = vectors.count()
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not n:
        return np.zeros((0, 0)), 0
    raw = _matrix(rows.column("embedding").combine_chunks())
    m = _directions(raw)
    k = min(CELLS, len(m), cells or max(1, round(n**0.5)))
    rng = np.random.default_rng(7)
    c = m[rng.choice(len(m), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(m @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, m)
        held = np.bincount(near, minlength=k) > 0
        c = _directions(np.where(held[:, None], sums, c))
    return c, probes_for(raw, c, np.argmax(m @ c.T, axis=1))


@dataclass
class Cells:
    spark: SparkSession
    root: str
    centroids: np.ndarray
    probes: int

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, name string, embedding array<double>, cell int").parquet(f"{self.root}/vectors")


def write(vectors: DataFrame, root: str, cells: int | None = None) -> Cells:
    """vectors(vec_id, name, embedding) by cell in the folder ``root``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("name").cast("string"), F.col("embedding").cast("array<double>"))
    centroids, probes = fit(rows, cells)

    def assigned(batches):
        for batch in batches:
            if batch.num_rows:
                near = np.argmax(_directions(_matrix(batch.column(2))) @ centroids.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "name", "embedding", "cell"])

    rows.mapInArrow(assigned, "vec_id long, name string, embedding array<double>, cell int").write.partitionBy("cell").parquet(f"{root}/vectors")
    return Cells(spark, root, centroids, probes)


def _nearest(ids: np.ndarray, matrix: np.ndarray, opened: np.ndarray, k: int):
    """Of a task's vectors the k best of each query among the cells it opens."""

    def run(batches):
        held: dict[int, list] = {q: [] for q in range(len(ids))}
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(3).to_numpy(zero_copy_only=False)
            vec, names, table = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
            for c in np.unique(cell):
                asks, at = np.flatnonzero(opened[:, c]), np.flatnonzero(cell == c)
                scores = np.floor(matrix[asks] @ table[at].T * 1e4 + 0.5) / 1e4
                for q, s in zip(asks.tolist(), scores, strict=True):
                    least = np.partition(s, -min(k, len(s)))[-min(k, len(s))]
                    best = np.flatnonzero(s >= least)
                    held[q] = sorted(held[q] + list(zip(-s[best], vec[at[best]].tolist(), names[at[best]], strict=True)))[:k]
        rows = [(int(ids[q]), v, n, -s) for q, some in held.items() for s, v, n in some]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "name", "score"])

    return run


def dense_search(stored: Cells, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """As ``search.dense_search``, of the ``probes`` nearest cells of each query (as many as were measured): query_id, rank, vec_id, name, score."""
    ship(stored.spark)
    spark, near, kind = stored.spark, None, "query_id long, vec_id long, name string, score double"
    for ids, matrix in search._query_blocks(queries):
        like = matrix @ stored.centroids.T if len(stored.centroids) else np.zeros((len(ids), 0))
        opened = np.zeros(like.shape, bool)
        np.put_along_axis(opened, np.argsort(-like, axis=1, kind="stable")[:, : probes or stored.probes], True, axis=1)
        some = stored.vectors.where(F.col("cell").isin(np.flatnonzero(opened.any(0)).tolist()))  # only these folders are read
        one = some.mapInArrow(_nearest(ids, matrix, opened, 2 * k), kind)
        near = one if near is None else cut(near).unionAll(one)
    return search.best_names(spark.createDataFrame([], kind) if near is None else near, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact search's rows that were found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
