"""Helpers shared by the operators of this package.

Texts reach Python as Arrow batches; everything per byte or per word is done on
numpy views of the Arrow buffers, in sub-blocks of bounded size, so that memory
depends on the block (or the longest single text) and not on the table.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import shipping as shipping_core

BLOCK_BYTES = 1 << 18
ARROW_BYTES = 4 << 20
_U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def py_crc_mod(doc_id, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, and bounds Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    shipping_core.ship(spark)


def shipping(f: Callable) -> Callable:
    """f(spark, …) with the package's code sent ahead."""

    @wraps(f)
    def run(spark, *args):
        ship(spark)
        return f(spark, *args)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is set, a temporary folder serves a session on one machine; a cluster must name one.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="notegraph-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """checkpoint() into the shared folder: the result outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_let_go(spark: SparkSession):
    """Within, a query's shuffle files go when it ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def consumed(df: DataFrame) -> None:
    """Runs df for what its tasks write; its shuffles go at the end."""
    with _shuffles_let_go(df.sparkSession):
        df.select("*").write.format("noop").mode("overwrite").save()


def gathered(df: DataFrame) -> list:
    """Rows of a bounded result; the shuffles that made it go at the end."""
    with _shuffles_let_go(df.sparkSession):
        return df.select("*").collect()


#: Folders of stored tables, oldest first.
_tables: list[str] = []


def hadoop(spark: SparkSession, path: str, f: Callable):
    """f(file system, path), of Hadoop's."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return f(at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at)


@contextmanager
def tables_let_go(spark: SparkSession):
    """Within, settle(df) stores df, after which all tables that were stored within before go."""
    began = len(_tables)

    def settle(df: DataFrame) -> DataFrame:
        old, out = _tables[began:], stored(df)
        for path in old:
            hadoop(spark, path, lambda fs, at: fs.delete(at, True))
            _tables.remove(path)
        return out

    yield settle


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; the shuffles that made it go with the write.

    Unlike a checkpoint the files are columnar and compressed, and later reads take the
    columns they need. They go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with _shuffles_let_go(spark):
        df.select("*").write.parquet(path)  # a new plan, which takes the setting
    hadoop(spark, path, lambda fs, at: fs.deleteOnExit(at))
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, *names: str) -> DataFrame:
    """All columns as one struct ``_row``, beside those named: whatever df's columns are called, none clashes."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), *(df[n] for n in names))


def text_key(text: Column) -> Column:
    """With doc_id, names a row's content. Rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: What names a row: by ``ROW_KEY``, rows with an id come before those without.
ROW_KEY = ["no_id", "id", "text_key"]
ROW_KEY_SCHEMA = "no_id boolean, id long, text_key long"


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """no_id, id, text_key: rows of one id are told apart by 64 bits of their texts, rows without by 128."""
    content = F.coalesce(text.cast("string"), F.lit(""))
    other = F.xxhash64(F.lit("id"), content)
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("long"), other).alias("id"), text_key(content).alias("text_key")]


def one_row_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, …) whose keys are in kept(row key), one of those that repeat. Each text is shuffled once."""
    keyed = packed(docs, "doc_id", "text").select("_row", *row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(kept, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).select("_row.*")


def id_of(no_id: Column, key: Column) -> Column:
    """The doc_id of a row key; null for a row without."""
    return F.when(~no_id, key)


# ----------------------------------------------------------------- Arrow blocks


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def blocks(off: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a block of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def map_blocks(f: Callable, text: str = "text", most: int = BLOCK_BYTES) -> Callable:
    """A mapInArrow function from f(batch slice, offsets, bytes) -> RecordBatch or None."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            off, data = text_buffers(batch.column(batch.schema.get_field_index(text)))
            for i, j in blocks(off, most):
                out = f(batch.slice(i, j - i), off[i : j + 1] - off[i], data[off[i] : off[j]])
                if out is not None and out.num_rows:
                    yield out

    return run


def kept_rows(docs: DataFrame, text: str, verdict: Callable) -> DataFrame:
    """The rows of docs for whose texts verdict(offsets, bytes) holds, block by block.

    Columns go through by number, so that no name clashes, and each value once.
    """
    names = docs.columns
    at, plain = names.index(text), docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        for batch in batches:
            off, data = text_buffers(batch.column(at))
            for i, j in blocks(off):
                out = batch.slice(i, j - i).filter(pa.array(verdict(off[i : j + 1] - off[i], data[off[i] : off[j]])))
                if out.num_rows:
                    yield out

    return plain.mapInArrow(run, plain.schema).toDF(*names)


# -------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class Roller:
    """Polynomial hashes modulo 2**64 of any substring of a block, from one prefix sum.

    Bytes go through a table of random words first. ``which`` chooses one of two
    independent bases, for 128-bit names.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, which: int = 0):
        self.which = which
        self.table = np.random.Generator(np.random.PCG64(2024 + which)).integers(1, 2**64 - 1, 256, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = self._powers.get(self.which)
        if got is None or len(got[0]) < n:
            size = max(n, 2 * BLOCK_BYTES)
            base = _BASES[self.which]
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            got = self._powers[self.which] = tuple(both)
        return got

    def prefix(self, data: np.ndarray) -> np.ndarray:
        p, _ = self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * p[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inv = self.powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Unmixed hashes of every window of ``length`` bytes."""
        n = len(prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        _, inv = self.powers(len(prefix))
        return (prefix[length:] - prefix[:n]) * inv[:n]


#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII upper case to lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that do not cross texts, and words per text."""
    inside = is_word[data]
    prev = np.zeros(len(data), bool)
    prev[1:] = inside[:-1]
    nxt = np.zeros(len(data), bool)
    nxt[:-1] = inside[1:]
    edges = off[:-1][off[:-1] < off[1:]]
    prev[edges] = False
    last = off[1:][off[:-1] < off[1:]] - 1
    nxt[last] = False
    start = np.flatnonzero(inside & ~prev)
    end = np.flatnonzero(inside & ~nxt) + 1
    per = np.diff(np.searchsorted(start, off))
    return start, end, per


def least_of_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width``, by block-wise running minima from both sides."""
    n = len(x) - width + 1
    whole = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(whole, axis=1).reshape(-1)
    behind = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


_PLACE = (np.uint64(1) << np.uint64(31)) - np.uint64(1)


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` hashes the place of the least, the rightmost of equal ones.

    Hashes are compared without their low 31 bits, which hold the place: the same for any
    block, or equal strings might choose differently.
    """
    place = np.arange(len(hashes), dtype=np.uint64)
    return (_PLACE - (least_of_windows((hashes & ~_PLACE) | (_PLACE - place), width) & _PLACE)).astype(np.int64)


def owners(per: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(per)), per)


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]], exact zero for empty ranges."""
    c = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]
