"""A streaming source of created and changed files: spark.readStream.format("media_changes").load(folder).

A file's stamp is the later of its content's and its entry's times, so a rewritten file, and one that was moved in with an old date, both
count as changed. A micro-batch holds the files stamped after the last one's end and up to SETTLE seconds before now: what is
still being written waits until it is quiet (the debounce), and a burst of writes to one file is one row. The offset is that end alone,
however many files there are, and deleting files doesn't move it. Folders are walked by tasks, one for each entry of the top folder; the driver lists only that.

The folder must be mounted on driver and executors alike, and clocks agree within SETTLE.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Seconds for which a file must be quiet.
SETTLE = 2.0
SCHEMA = "path string, ts timestamp, length long"


@dataclass
class Part(InputPartition):
    """What one task walks: a folder, or one file, and the stamps (nanoseconds) after which and up to which it reports."""

    path: str
    after: int
    until: int


def stamped(path: str) -> Iterator[tuple[str, int, int]]:
    """(path, stamp, size) of every file at or below the path; what vanishes meanwhile is left out, links to folders aren't followed."""
    try:
        if os.path.isdir(path):
            with os.scandir(path) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        yield from stamped(e.path)
                    elif e.is_file():
                        found = e.stat()
                        yield e.path, max(found.st_mtime_ns, found.st_ctime_ns), found.st_size
        else:
            found = os.stat(path)
            yield path, max(found.st_mtime_ns, found.st_ctime_ns), found.st_size
    except OSError:
        return


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str, settle: float):
        self.folder, self.settle = folder, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        try:
            names = sorted(os.listdir(self.folder))
        except FileNotFoundError:
            names = []
        return [Part(os.path.join(self.folder, n), start["until"], end["until"]) for n in names]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, stamp, size in stamped(partition.path):
            if partition.after < stamp <= partition.until:
                yield path, datetime.fromtimestamp(stamp / 1e9, timezone.utc), size

    def commit(self, end: dict) -> None:
        pass


class MediaChanges(DataSource):
    """Options: path (the folder), settle (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "media_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> Reader:  # noqa: N802
        folder = self.options.get("path")
        if not folder:
            raise ValueError("media_changes needs a folder")
        return Reader(folder.removeprefix("file://"), float(self.options.get("settle", SETTLE)))


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known to a session."""
    spark.dataSource.register(MediaChanges)
    return spark
