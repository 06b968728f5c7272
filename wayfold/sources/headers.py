"""A data source of media headers: ``spark.read.format("media_headers").load(folder)`` after ``register``.

A folder is listed once; files are dealt to tasks by count (``files_per_task``), not by size, since of each only the headers of its boxes and its moov box are read, whatever its length. Filters on
``path`` and ``extension`` are taken at the listing, so files that they rule out are never opened. Columns: path, extension, length, box, created, modified (seconds since 1904, unsigned, so decimals),
error. A file that can't be walked gives a row with its error, and so does one that another filter would have left.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from . import boxes, files

SCHEMA = "path string, extension string, length long, box string, created decimal(20,0), modified decimal(20,0), error string"
FILES_PER_TASK = 64


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


class Group(InputPartition):
    def __init__(self, found: list[tuple[str, int]]):
        super().__init__(found)
        self.found = found


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("files_per_task", FILES_PER_TASK))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {EqualTo: "=", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}
        for f in filters:
            if type(f) in names and f.attribute in (("path",), ("extension",)):
                self.tests.append((f.attribute[0], names[type(f)], f.value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        tests = {"=": lambda v, x: v == x, "in": lambda v, x: v in x, "starts": lambda v, x: v.startswith(x), "ends": lambda v, x: v.endswith(x), "holds": lambda v, x: x in v}
        own = {"path": path, "extension": _extension(path)}
        return all(tests[kind](own[column], value) for column, kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        found = [f for f in files.listed(self.path) if self._wanted(f[0])]
        return [Group(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        system, _ = files.located(self.path)
        for path, length in partition.found:
            extension = _extension(path)
            try:
                with system.open_input_file(path) as file:
                    found = boxes.timestamps(boxes.moov_body(file, length))
            except (ValueError, struct.error, IndexError, OSError) as e:
                yield path, extension, length, None, None, None, str(e)
                continue
            for box, created, modified in found:
                yield path, extension, length, box, Decimal(created), Decimal(modified), None


class MediaHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``media_headers`` known to the session, with filters handed on to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaHeaders)
