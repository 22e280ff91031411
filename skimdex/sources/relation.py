"""A relation that makes its rows itself and takes filters from the planner: Spark's Python data source API."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

_LOW, _HIGH = (GreaterThan, GreaterThanOrEqual, EqualTo), (LessThan, LessThanOrEqual, EqualTo)
_ROWS = 65536


class Stretch(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Series(DataSource):
    """``id`` from ``start`` up to ``end`` (not in it), and ``half``, which is null for odd ids, in ``partitions`` parts."""

    @classmethod
    def name(cls) -> str:
        return "skimdex_series"

    def schema(self) -> str:
        return "id long, half long"

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(int(self.options.get("start", 0)), int(self.options["end"]), int(self.options.get("partitions", 4)))


class SeriesReader(DataSourceReader):
    def __init__(self, start: int, end: int, parts: int):
        self.start, self.end, self.parts = start, end, parts

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on ``id`` narrow the series; what is left over is for Spark."""
        for f in filters:
            kind = type(f)
            if kind not in _LOW + _HIGH or f.attribute != ("id",):
                yield f
                continue
            if kind in _LOW:
                self.start = max(self.start, f.value + (kind is GreaterThan))
            if kind in _HIGH:
                self.end = min(self.end, f.value + (kind is not LessThan))

    def partitions(self) -> list[InputPartition]:
        size = max(0, self.end - self.start)
        edges = [self.start + size * i // self.parts for i in range(self.parts + 1)]
        return [Stretch(a, b) for a, b in zip(edges, edges[1:]) if a < b] or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for at in range(partition.start, partition.end, _ROWS):
            ids = range(at, min(at + _ROWS, partition.end))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([None if i % 2 else i // 2 for i in ids], pa.int64())], ["id", "half"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Series)
