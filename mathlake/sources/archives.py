"""Members of zip archives as a data source of Spark: spark.read.format("zip_members").load(folder or file).

One partition an archive. Of an archive its directory is read, and of its members those alone that a filter on `name` or
`size` leaves and whose content is asked for: option("contents", "word/*.xml") names them by a pattern, "*" by default,
"" none; other members have null content. Members are read one after the other, archives never whole. Paths are those of
any store that pyarrow opens (local, file:, hdfs:, s3:, ...).
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterable, Iterator
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from ..cluster import ship

#: What a pushed filter says of a member's value.
TESTS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else path
    return fs.FileSystem.from_uri(path)


class Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.contents = options["path"], options.get("contents", "*")
        self.tests: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in TESTS and column in ("name", "size"):
                self.tests.append((column, type(f), f.value))
            else:
                yield f  # Spark tests the rest

    def partitions(self) -> list[InputPartition]:
        store, at = opened(self.path)
        info = store.get_file_info(at)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.value) as file, zipfile.ZipFile(file) as archive:
            for member in archive.infolist():
                value = {"name": member.filename, "size": member.file_size}
                if all(TESTS[kind](value[column], x) for column, kind, x in self.tests):
                    content = archive.read(member) if fnmatch.fnmatchcase(member.filename, self.contents) else None
                    yield partition.value, member.filename, member.file_size, content


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, name string, size long, content binary"

    def reader(self, schema: Any) -> DataSourceReader:
        return MemberReader(self.options)


def members(spark: SparkSession, path: str, contents: str = "*") -> DataFrame:
    """path, name, size, content of the members of a zip archive or of all archives under a folder."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("contents", contents).load(path)
