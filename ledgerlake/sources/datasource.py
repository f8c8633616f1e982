"""`spark.read.format("ledgerlake").option("relation", "tables").load(path)`: a relation of one lake file, read by one task."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import state
from ..operators.replay import RELATIONS, rows_of


class LakeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledgerlake"

    def schema(self) -> str:
        return RELATIONS[self.options.get("relation", "tables")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("relation", "tables"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, relation: str):
        self.path, self.relation = path, relation

    def partitions(self):
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition):
        path = partition.value
        if "://" in path:
            from pyarrow import fs

            where, at = fs.FileSystem.from_uri(path)
            with where.open_input_stream(at) as f:
                data = f.read()
        else:
            with open(path.removeprefix("file:"), "rb") as f:
                data = f.read()
        yield from rows_of(path, state.load(data), self.relation)
