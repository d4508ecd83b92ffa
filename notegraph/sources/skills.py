"""A skill store as a data source: a table of an SQLite file, read in parts, with filters sent to it.

``spark.read.format("skillstore").option("path", file).option("table", "skills").load()``. Columns are those of the table,
by their declared types; without a table the first one that has a text column is read. Parts are ranges of
row numbers (``parts``, 8 by default). The file must lie on a path that all workers see. It is opened for reading only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from notegraph.shipping import ship

ROWS = 10_000
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def _kind(declared: str):
    """The type of a column by SQLite's rules of affinity."""
    d = (declared or "").upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return BinaryType() if "BLOB" in d else StringType()


def discover(path: str, table: str | None) -> tuple[str, StructType]:
    """The table and its columns."""
    with _open(path) as con:
        names = [table] if table else [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        for name in names:
            fields = [StructField(r[1], _kind(r[2])) for r in con.execute(f"PRAGMA table_info({_quoted(name)})")]
            if any(isinstance(f.dataType, StringType) for f in fields):
                return name, StructType(fields)
    raise ValueError(f"{path} has no table with text")


@dataclass
class Rows(InputPartition):
    least: int
    most: int


class SkillReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int):
        self.path, self.table, self.columns, self.parts = path, table, schema, parts
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes those that SQLite answers as Spark does, and hands back the others."""
        for f in filters:
            sql = self._sql(f)
            if sql is None:
                yield f
            else:
                self.conditions.append(sql)

    def _sql(self, f: Filter) -> tuple[str, list] | None:
        name = f.attribute[0]
        if len(f.attribute) > 1 or name not in self.columns.names:
            return None
        cell = self._cell(self.columns[name])
        if isinstance(f, IsNull | IsNotNull):
            return f"{cell} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
        if isinstance(self.columns[name].dataType, BinaryType):
            return None
        if isinstance(f, StringContains):
            return f"instr({cell}, ?) > 0", [f.value]
        if isinstance(f, StringStartsWith):
            return f"substr({cell}, 1, ?) = ?", [len(f.value), f.value]
        if isinstance(f, EqualNullSafe):
            return f"{cell} IS ?", [f.value]
        if isinstance(f, In):
            return f"{cell} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if type(f) in _COMPARED:
            return f"{cell} {_COMPARED[type(f)]} ?", [f.value]
        return None

    def _cell(self, field: StructField) -> str:
        """A column under its declared type, as a cell of SQLite may hold any."""
        kind = {LongType: "INTEGER", DoubleType: "REAL", StringType: "TEXT"}.get(type(field.dataType), "BLOB")
        return f"CAST({_quoted(field.name)} AS {kind})"

    def partitions(self) -> list[Rows]:
        with _open(self.path) as con:
            least, most = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if least is None:
            return [Rows(0, -1)]
        step = -(-(most - least + 1) // self.parts)
        return [Rows(i, min(i + step - 1, most)) for i in range(least, most + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        kinds = {LongType: pa.int64(), DoubleType: pa.float64(), StringType: pa.string()}
        schema = pa.schema([(f.name, kinds.get(type(f.dataType), pa.binary())) for f in self.columns])
        where = " AND ".join(["rowid BETWEEN ? AND ?", *(f"({sql})" for sql, _ in self.conditions)])
        asked = f"SELECT {', '.join(self._cell(f) for f in self.columns)} FROM {_quoted(self.table)} WHERE {where}"
        with _open(self.path) as con:
            rows = con.execute(asked, [partition.least, partition.most, *(v for _, values in self.conditions for v in values)])
            while some := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


class SkillStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skillstore"

    def _found(self) -> tuple[str, StructType]:
        return discover(self.options["path"], self.options.get("table"))

    def schema(self) -> StructType:
        return self._found()[1]

    def reader(self, schema: StructType) -> SkillReader:
        return SkillReader(self.options["path"], self._found()[0], schema, int(self.options.get("parts", 8)))


def read_skills(spark: SparkSession, path: str, table: str | None = None, parts: int = 8):
    """The skill store at path, with filters sent to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(SkillStore)
    reader = spark.read.format("skillstore").option("path", path).option("parts", parts)
    return (reader.option("table", table) if table else reader).load()
