"""A folder of notes as a stream of its changes: path, change (added, changed, removed), modified, length.

An offset is a listing, of path, time and size of each ``*.md`` below the folder outside dot directories, so a batch is
the difference of two listings, a restart goes on from the one in the checkpoint, and a file that has gone is told too. The listing is
held by the driver and written to the checkpoint at every change: folders of more than ``most`` notes (100,000 unless the option says
otherwise) are refused; ``streams.watch`` compares listings as tables for them.

``spark.readStream.format("notechanges").option("path", folder).load()``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from notegraph.shipping import ship
from notegraph.sources.readers import HIDDEN

SCHEMA = "path string, change string, modified timestamp, length long"
ROWS_A_PART = 10_000


def listing(folder: str, most: int) -> dict[str, list[int]]:
    """path below folder -> microseconds of change, bytes; in order of path."""
    uri = folder if "://" in folder else f"file://{folder}"
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    out = {}
    for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True, recursive=True)):
        path = f.path[len(root) :].lstrip("/")
        if f.type == pyarrow.fs.FileType.File and path.endswith(".md") and not re.search(HIDDEN, path):
            out[path] = [f.mtime_ns // 1000, f.size]
            if len(out) > most:
                raise ValueError(f"{folder} has more than {most} notes")
    return dict(sorted(out.items()))


def difference(old: dict, new: dict) -> list[tuple[str, str, int | None, int | None]]:
    told = [(p, "changed" if p in old else "added", *new[p]) for p in new if old.get(p) != new[p]]
    return sorted(told + [(p, "removed", None, None) for p in old if p not in new])


@dataclass
class Changes(InputPartition):
    rows: list


class ChangeReader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {"listing": {}}

    def latestOffset(self) -> dict:
        return {"listing": listing(self.folder, self.most)}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        rows = difference(start["listing"], end["listing"])
        return [Changes(rows[i : i + ROWS_A_PART]) for i in range(0, len(rows), ROWS_A_PART)] or [Changes([])]

    def read(self, partition: Changes) -> Iterator[tuple]:
        from datetime import UTC, datetime

        for path, change, modified, length in partition.rows:
            yield path, change, None if modified is None else datetime.fromtimestamp(modified / 1e6, UTC), length


class NoteChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notechanges"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["path"], int(self.options.get("most", 100_000)))


def note_changes(spark: SparkSession, folder: str, most: int = 100_000) -> DataFrame:
    """The stream of a folder's changes."""
    ship(spark)
    spark.dataSource.register(NoteChanges)
    return spark.readStream.format("notechanges").option("path", folder).option("most", most).load()
