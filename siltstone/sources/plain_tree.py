"""A data source that lists a tree of files on a shared mount without going through links."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Folder(InputPartition):
    """A folder below the root with all that is in it, or only the root's own files."""

    path: str
    deep: bool


class PlainTree(DataSource):
    """Files below ``path`` as (path, folder, name, size, content): each once, and none that is a link or lies behind one.

    A task reads a folder of the root; the driver lists no more than the root itself. With ``contents`` false there are none. Files that
    can't be read have a null content.
    """

    @classmethod
    def name(cls) -> str:
        return "plain_tree"

    def schema(self) -> str:
        return "path string, folder string, name string, size long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("contents", "true").lower() != "false")


class Reader(DataSourceReader):
    def __init__(self, root: str, contents: bool):
        self.root, self.contents = root.rstrip("/") or "/", contents

    def partitions(self) -> list[Folder]:
        if os.path.islink(self.root):
            return []
        with os.scandir(self.root) as found:
            return [Folder(self.root, False), *(Folder(e.path, True) for e in found if e.is_dir(follow_symlinks=False))]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        left = [partition.path] if partition else []  # none where there are no partitions
        while left:
            folder = left.pop()
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        left += [e.path] * partition.deep
                    elif e.is_file(follow_symlinks=False):
                        yield e.path, folder, e.name, e.stat(follow_symlinks=False).st_size, self._content(e.path)

    def _content(self, path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read() if self.contents else None
        except OSError:
            return None


def scan_plain(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """The files below ``root``, which all executors see under the same name, without links."""
    spark.dataSource.register(PlainTree)
    return spark.read.format("plain_tree").option("path", root).option("contents", str(contents)).load()
