"""A folder of notes as a Spark data source: spark.read.format("notes").option("exclude", "a,b").load(folder).

One row for each entry of the walk, with its kind (note or left-out) and reason. The walk itself is
one task; it lists names only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from passagelake.sources.folder import walk


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found = walk(self.options["path"], tuple(x for x in self.options.get("exclude", "").split(",") if x))
        for key, file, path, size, when in found.notes:
            yield "note", key, None, file, path, size, when
        for key, reason, size, when, path in found.left_out:
            yield "left-out", key, reason, None, path, size, when


class NotesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "kind string, key string, reason string, file string, abs string, size bigint, mtime_ms bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NotesSource)
