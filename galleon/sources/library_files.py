"""Library files as a data source: every file below a root as (file_path, file_name, extension, mtime).

Spark's own listing hides names that begin with _ or a dot at any depth; this one hides dot entries at the top only,
and partial downloads (*.part). Directories that can't be read are rows with failed = true.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_path string, file_name string, extension string, mtime double, failed boolean"


def split_name(name: str) -> tuple[str, str]:
    at = name.rfind(".")
    return (name[:at], name[at + 1 :]) if at > 0 else (name, "")


class Part(InputPartition):
    def __init__(self, top: str | None) -> None:
        self.top = top


class LibraryReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        """One task per top-level directory, and one for the files beside them, or for a root that can't be read."""
        try:
            tops = [e.name for e in os.scandir(self.root) if e.is_dir() and not e.name.startswith(".")]
        except OSError:
            tops = []
        return [Part(None), *map(Part, sorted(tops))]

    def read(self, partition: Part) -> Iterator[tuple]:
        bad: list[str] = []
        walk = os.walk(os.path.join(self.root, partition.top or ""), onerror=lambda e: bad.append(e.filename))
        for here, folders, names in walk:
            folder = os.path.relpath(here, self.root).replace(os.sep, "/")
            if partition.top is None:
                folders.clear()  # the other tasks go down
                names = [n for n in names if not n.startswith(".")]
            for name in names:
                if not name.endswith(".part"):
                    try:
                        yield (folder, *split_name(name), os.stat(os.path.join(here, name)).st_mtime, False)
                    except FileNotFoundError:  # gone since the directory was read, as if it had never been there
                        continue
        for path in bad:
            yield (os.path.relpath(path, self.root).replace(os.sep, "/"), None, None, None, True)


class LibrarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LibraryReader(self.options["path"])


def scan_library(spark: SparkSession, root: str):
    spark.dataSource.register(LibrarySource)
    return spark.read.format("library_files").load(root)
