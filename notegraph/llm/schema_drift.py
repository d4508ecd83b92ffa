"""Rewrite of Parquet files whose schemas have drifted, as a chain of single-bit migrations.

The evolved schema is a list of fields with ids, names, types and defaults. Files keep the ids
whatever else has changed, so a file's drift is read from its footer alone, as bits: names
differ (1), order differs (2), fields are missing (4), types differ (8). Each bit has one transform of an
Arrow table, ``rename``, ``reorder``, ``add`` and ``widen``; a file's chain is composed of those of its
bits, from the cheapest to the widest, and runs lazily over the file's batches, so a task holds
one batch and the writer's row group. A file of no drift is not touched.

Files go to tasks one by one. Spark lists them, and a task opens them through the file system that their
path names. A rewritten file is staged beside the folder and moved into place; it keeps in its footer which
columns and drift it had, so that a task that runs again finds and reports its own work.

``deal`` makes such files: rows are dealt by range of a sort key, whatever its hot values, and
numbered by where their range begins: of these ranges, as many as there are partitions, only the sizes go through one task.
One file is written by one task, streaming.

Edge cases: an empty table makes no files. Rows equal in the sort key are ordered by all other columns' hash; a
null key counts as the empty text and comes first. Nulls stay nulls, in missing columns too no null is made. Columns that carry no id
of the schema do not pass; a name that another field once had is no clash, as only ids count. Two columns of
one id in a file are an error. NaN balances and infinite ones are written as nan, inf and -inf in digests. Very long
values are limited by one batch of 1,024 rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.llm.common import consumed, hadoop, shared_dir, stored

RENAMED, REORDERED, MISSING, NARROWED = 1, 2, 4, 8
ID = b"PARQUET:field_id"
#: In the footer of a rewritten file: the columns and the drift it had.
START, DRIFT = b"start_columns", b"drift"
BATCH_ROWS = 1024
GROUP_BYTES = 16 << 20
Batches = Iterator[pa.Table]


def field(number: int, name: str, kind: pa.DataType) -> pa.Field:
    return pa.field(name, kind, nullable=True, metadata={ID: str(number).encode()})


def ids(schema: pa.Schema) -> list[int | None]:
    """The field ids of a file's columns; two of one id are an error."""
    out = [int(f.metadata[ID]) if f.metadata and ID in f.metadata else None for f in schema]
    if len(known := [i for i in out if i is not None]) > len(set(known)):
        raise ValueError(f"field ids repeat: {known}")
    return out


# ------------------------------------------------------------------- the chain


def detect(schema: pa.Schema, evolved: pa.Schema) -> int:
    """The drift bits of a file's schema."""
    there, want = dict(zip(ids(schema), schema, strict=True)), dict(zip(ids(evolved), evolved, strict=True))
    there.pop(None, None)
    held = [i for i in there if i in want]
    bits = RENAMED * any(there[i].name != want[i].name for i in held)
    bits |= REORDERED * (held != [i for i in want if i in there] or len(held) < len(schema))
    bits |= MISSING * (len(held) < len(want))
    return bits | NARROWED * any(there[i].type != want[i].type for i in held)


def rename(evolved: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    names = dict(zip(ids(evolved), evolved.names, strict=True))
    return lambda t: t.rename_columns([names.get(i, n) for i, n in zip(ids(t.schema), t.column_names, strict=True)])


def reorder(evolved: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Columns in the schema's order; those it doesn't know do not pass."""

    def f(t: pa.Table) -> pa.Table:
        at = {i: k for k, i in enumerate(ids(t.schema)) if i is not None}
        return t.select([at[i] for i in ids(evolved) if i in at])

    return f


def add(evolved: pa.Schema, defaults: dict[int, object]) -> Callable[[pa.Table], pa.Table]:
    """Missing columns, of their defaults, before the first column that stands later in the schema than they do."""
    order = {i: k for k, i in enumerate(ids(evolved))}

    def f(t: pa.Table) -> pa.Table:
        for i, want in zip(ids(evolved), evolved, strict=True):
            there = ids(t.schema)
            if i not in there:
                at = next((k for k, x in enumerate(there) if order.get(x, -1) > order[i]), len(there))
                t = t.add_column(at, want, pa.repeat(pa.scalar(defaults.get(i), want.type), t.num_rows))
        return t

    return f


def widen(evolved: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    types = dict(zip(ids(evolved), evolved.types, strict=True))

    def f(t: pa.Table) -> pa.Table:
        return t.cast(pa.schema([x.with_type(types.get(i, x.type)) for i, x in zip(ids(t.schema), t.schema, strict=True)]))

    return f


def chain(bits: int, evolved: pa.Schema, defaults: dict[int, object]) -> Callable[[Batches], Batches]:
    """The transforms of the set bits, fused: each batch goes through all of them before the next is read."""
    of = {RENAMED: rename(evolved), REORDERED: reorder(evolved), NARROWED: widen(evolved), MISSING: add(evolved, defaults)}
    steps = [f for bit, f in of.items() if bits & bit]
    return lambda batches: (reduce(lambda t, f: f(t), steps, t) for t in batches)


def _read(file: pq.ParquetFile) -> Batches:
    return (pa.Table.from_arrays(b.columns, schema=file.schema_arrow) for b in file.iter_batches(BATCH_ROWS))


class Writer:
    """A Parquet file under a name of its own until it is whole; row groups of about ``GROUP_BYTES``."""

    def __init__(self, fs: pyarrow.fs.FileSystem, staging: str, schema: pa.Schema):
        fs.create_dir(staging)
        self.fs, self.part = fs, f"{staging}/{uuid.uuid4().hex}.parquet"
        self.out, self.held, self.schema = pq.ParquetWriter(fs.open_output_stream(self.part), schema), [], schema

    def write(self, t: pa.Table) -> None:
        self.held.append(t)
        if sum(x.nbytes for x in self.held) >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            t = pa.concat_tables(self.held)
            self.out.write_table(t, row_group_size=max(1, t.num_rows))
            self.held = []

    def close(self, path: str) -> None:
        self._flush()
        self.out.close()
        self.fs.move(self.part, path)


def migrate(fs: pyarrow.fs.FileSystem, path: str, staging: str, evolved: pa.Schema, defaults: dict[int, object]) -> tuple[int, list[str]]:
    """The file at path in the evolved schema; its drift and the columns it had."""
    with pq.ParquetFile(fs.open_input_file(path)) as file:
        schema = file.schema_arrow
        if DRIFT in (schema.metadata or {}):
            return int(schema.metadata[DRIFT]), schema.metadata[START].decode().split(",")
        bits, names = detect(schema, evolved), schema.names
        if not bits:
            return 0, names
        target = evolved.with_metadata({START: ",".join(names), DRIFT: str(bits)})
        out = Writer(fs, staging, target)
        for t in chain(bits, evolved, defaults)(_read(file)):
            out.write(t.cast(target))
    out.close(path)
    return bits, names


def rewrite(spark: SparkSession, folder: str, evolved: pa.Schema, defaults: dict[int, object], digest: Callable | None = None) -> DataFrame:
    """Each Parquet file of folder in the evolved schema: path, version (its drift), rewritten, n_rows, start_columns, columns, and digest's columns.

    digest(tables) -> dict gets the final file's batches; its keys are n_nulls, ids_sha256 and rows_sha256.
    """
    staging = f"{folder.rstrip('/')}-staging-{uuid.uuid4().hex}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path")
    schema = pa.schema([("path", pa.string()), ("version", pa.int64()), ("rewritten", pa.bool_()), ("n_rows", pa.int64()), ("n_nulls", pa.int64()), ("ids_sha256", pa.string()), ("rows_sha256", pa.string()), ("start_columns", pa.string()), ("columns", pa.string())])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, own = _file_system(path)
                bits, names = migrate(fs, own, _file_system(staging)[1], evolved, defaults)
                with pq.ParquetFile(fs.open_input_file(own)) as file:
                    said = {"path": _uri(path), "version": bits, "rewritten": bits > 0, "n_rows": file.metadata.num_rows, "start_columns": ",".join(names), "columns": ",".join(file.schema_arrow.names)}
                    said |= digest(_read(file)) if digest else {}
                yield pa.RecordBatch.from_pylist([said], schema)

    # the scan packs files into tasks by their bytes
    done = files.mapInArrow(run, "path string, version long, rewritten boolean, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string")
    done = stored(done)
    hadoop(spark, staging, lambda fs, at: fs.delete(at, True))
    return done


def _uri(path: str) -> str:
    """file:/x, as Hadoop writes it, is file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path names, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(_uri(path))


# --------------------------------------------------------------- making drifted files


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*(df[c] for c in df.columns))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with ``_row``, its place from 0 in the order: dealt by range, numbered within each, and moved by where its range begins.

    Rows of equal order are dealt apart by their number in the input, so that no value fills a task.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.select(F.struct(*df.columns).alias("_r"), *(c.alias(k) for k, c in zip(keys, order, strict=True)), row_hash(df).alias("_h"), F.monotonically_increasing_id().alias("_at"))
    by = [*keys, "_h", "_at"]
    local = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("_r", F.monotonically_increasing_id().alias("_n"))
    dealt = stored(dealt.select("_r", F.shiftrightunsigned("_n", 33).alias("_part"), local.alias("_place")))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a partition
    begins = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_begin"))
    return dealt.join(F.broadcast(begins), "_part").select("_r.*", (F.col("_begin") + F.col("_place")).alias("_row"))


def drifted(evolved: pa.Schema, bits: int, swap: tuple[int, int], gone: tuple[int, ...], narrow: dict[int, pa.DataType]) -> pa.Schema:
    """The evolved schema as it was by the bits: two names swapped, all but the first column reversed, columns gone, types narrower."""
    names = dict(zip(ids(evolved), evolved.names, strict=True))
    fields = dict(zip(ids(evolved), evolved, strict=True))
    if bits & RENAMED:
        fields |= {a: fields[a].with_name(names[b]) for a, b in (swap, swap[::-1])}
    if bits & NARROWED:
        fields |= {i: fields[i].with_type(t) for i, t in narrow.items()}
    first, *rest = [i for i in fields if not (bits & MISSING and i in gone)]
    return pa.schema([fields[i] for i in (first, *(rest[::-1] if bits & REORDERED else rest))])


def deal(rows: DataFrame, folder: str, evolved: pa.Schema, schema_of: Callable[[int], pa.Schema]) -> None:
    """Writes rows(evolved columns, file_no, _row) as one file a number, in the schema that schema_of(number) names, in order of _row.

    A task writes its files one after the other, a batch at a time, and each is moved into the folder when whole.
    """
    staging = f"{folder.rstrip('/')}-making-{uuid.uuid4().hex}"
    names = dict(zip(ids(evolved), evolved.names, strict=True))

    def run(batches):
        out = held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            numbers = t.column("file_no").to_numpy()
            cuts = [0, *((numbers[1:] != numbers[:-1]).nonzero()[0] + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and (number := int(numbers[a])) != held:
                    if out is not None:
                        out.close(path)
                    fs, own = _file_system(folder)
                    held, path, schema = number, f"{own}/file-{number:09d}.parquet", schema_of(number)
                    out = Writer(fs, _file_system(staging)[1], schema)
                if a < b:
                    out.write(_as(t.slice(a, b - a).select([names[i] for i in ids(schema)]), schema))
        if out is not None:
            out.close(path)
        yield from ()

    dealt = rows.repartition("file_no").sortWithinPartitions("file_no", "_row").select(*evolved.names, "file_no")
    hadoop(rows.sparkSession, folder, lambda fs, at: fs.mkdirs(at))
    consumed(dealt.mapInArrow(run, "file_no long"))
    hadoop(rows.sparkSession, staging, lambda fs, at: fs.delete(at, True))


def _as(t: pa.Table, schema: pa.Schema) -> pa.Table:
    """t's columns under another schema of as many; floats lose what they must."""
    return pa.Table.from_arrays([c.cast(f.type, safe=False) for c, f in zip(t.columns, schema, strict=True)], schema=schema)


# ------------------------------------------------------------------ the shop's clients

SEED, VERSIONS, KNOWN, FILES = 42, 24, 15, 500
NAMES = "client_id master_id source updated_at name email city nation_id segment balance".split()
DEFAULTS = {3: "none", 8: -1}


def clients_schema(updated_at: pa.DataType) -> pa.Schema:
    kinds = dict.fromkeys(NAMES, pa.string()) | {"client_id": pa.int64(), "master_id": pa.int64(), "updated_at": updated_at, "nation_id": pa.int64(), "balance": pa.float64()}
    return pa.schema([field(i, n, kinds[n]) for i, n in enumerate(NAMES, 1)])


def version_of(number: int) -> int:
    v = zlib.crc32(f"{SEED}:{number}".encode()) % VERSIONS
    return v if v <= KNOWN else 0


def start_schema(evolved: pa.Schema, number: int) -> pa.Schema:
    return drifted(evolved, version_of(number), swap=(5, 6), gone=(8, 3), narrow={8: pa.int32(), 10: pa.float32()})


def _texts(t: pa.Table) -> list[pa.Array]:
    """Columns as the digest writes them, nulls as ?."""
    out = []
    for f, c in zip(t.schema, t.columns, strict=True):
        if pa.types.is_timestamp(f.type):
            c = c.cast(pa.timestamp("us", f.type.tz)).cast(pa.int64())
        if pa.types.is_floating(f.type):
            c = pc.multiply(c, 1048576.0)
            if pc.all(pc.less(pc.abs(c), 2.0**62)).as_py() in (True, None):
                c = pc.floor(c).cast(pa.int64())
            else:
                c = pa.array([None if v is None else str(math.floor(v)) if math.isfinite(v) else str(v) for v in c.to_pylist()], pa.string())
        out.append(pc.fill_null(c.cast(pa.string()), "?"))
    return out


def clients_digest(tables: Batches) -> dict:
    """n_nulls, ids_sha256, rows_sha256 of a file, a batch at a time."""
    of_ids, of_rows, nulls, comma = hashlib.sha256(), hashlib.sha256(), 0, False
    for t in tables:
        if not t.num_rows:
            continue
        nulls += sum(c.null_count for c in t.columns)
        columns = _texts(t)
        lines = pc.binary_join_element_wise(*columns, "|").to_pylist()
        of_ids.update(("," * comma + ",".join(columns[0].to_pylist())).encode())
        of_rows.update(("\n" * comma + "\n".join(lines)).encode())
        comma = True
    return {"n_nulls": nulls, "ids_sha256": of_ids.hexdigest(), "rows_sha256": of_rows.hexdigest()}


def write_clients(clients: DataFrame, folder: str) -> pa.Schema:
    """clients as drifted files; the evolved schema."""
    c = clients
    zoned = dict(c.dtypes)["updated_at"] == "timestamp"
    evolved = clients_schema(pa.timestamp("us", "UTC" if zoned else None))
    kinds = dict.fromkeys(NAMES, "string") | {"client_id": "long", "master_id": "long", "updated_at": "timestamp" if zoned else "timestamp_ntz", "nation_id": "long", "balance": "double"}
    rows = c.select(*(c[n].cast(kinds[n]).alias(n) for n in NAMES))
    per = 1 + rows.count() // FILES
    key = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")).cast("binary"))
    placed = numbered(rows, [key, F.col("client_id")])
    deal(placed.withColumn("file_no", F.expr(f"_row div {per}")), folder, evolved, lambda number: start_schema(evolved, number))
    return evolved


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this call under the shared one; it is left there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return hadoop(spark, path, lambda fs, at: fs.makeQualified(at).toString())


def rewrite_clients(clients: DataFrame) -> DataFrame:
    """clients as drifted files in a new folder, rewritten there; a row for each final file."""
    spark = clients.sparkSession
    folder = new_folder(spark, "clients") + "/files"
    evolved = write_clients(clients, folder)
    done = rewrite(spark, folder, evolved, DEFAULTS, clients_digest)
    number = F.regexp_extract("path", r"file-(\d+)\.parquet$", 1).cast("long")
    return done.select(number.alias("file_no"), "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
