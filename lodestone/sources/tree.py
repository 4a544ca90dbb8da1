"""A Spark data source for source trees on a file system every executor can read.

Spark's own file sources leave out names that start with ``_`` or ``.`` and files of length zero,
which in a source tree are modules like ``__init__.py``. The tree is listed once (names and sizes
only) and cut into partitions of similar size; content is read in the tasks.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTITION_BYTES = 16 << 20
PARTITION_FILES = 2000


class FileBatch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.ignored = set(options.get("ignored", "").split(","))
        self.names_only = options.get("namesonly", options.get("namesOnly", "false")) == "true"
        self.extensions = tuple(e for e in options.get("extensions", "").split(",") if e)

    def _wanted(self, name: str) -> bool:
        return not self.extensions or os.path.splitext(name)[1] in self.extensions

    def partitions(self) -> list[InputPartition]:
        batches, current, size = [], [], 0
        for folder, names, files in os.walk(self.root):
            names[:] = sorted(n for n in names if n not in self.ignored)
            for name in sorted(filter(self._wanted, files)):
                full = os.path.join(folder, name)
                current.append(os.path.relpath(full, self.root))
                size += 0 if self.names_only else os.path.getsize(full)
                if size >= PARTITION_BYTES or len(current) >= PARTITION_FILES:
                    batches.append(FileBatch(current))
                    current, size = [], 0
        return [*batches, FileBatch(current)]

    def read(self, partition: FileBatch) -> Iterator[tuple[str, str | None]]:
        for path in partition.paths:
            content = None
            if not self.names_only:
                with open(os.path.join(self.root, path), encoding="utf-8", errors="replace", newline="") as file:
                    content = file.read()
            yield path.replace(os.sep, "/"), content


class SourceTree(DataSource):
    """Options: path, ignored (folder names), extensions, namesOnly."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return SourceTreeReader(dict(self.options))
