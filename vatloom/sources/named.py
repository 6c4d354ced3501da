"""Sources that a session knows by name: ``spark.read.format(...)`` once they are registered."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The lines of the receipt that the fixture repeats.
RECEIPT = ("CỬA HÀNG SEN", "Hóa đơn bán hàng", "Số HĐ: B-001", "Ngày: 05/06/2024", "Tổng cộng: 120.000 đ")


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Receipts(DataSourceReader):
    def __init__(self, count: int, parts: int):
        self.count, self.parts = count, max(1, min(parts, count or 1))

    def partitions(self) -> list[Range]:
        cut = [self.count * i // self.parts for i in range(self.parts + 1)]
        return [Range(a, b) for a, b in zip(cut, cut[1:])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for doc_id in range(partition.start, partition.end):
            for i, text in enumerate(RECEIPT):
                yield doc_id, 1, i + 1, text, 0.96


class Fixture(DataSource):
    """Lines of ``count`` equal receipts, made in ``partitions`` tasks."""

    @classmethod
    def name(cls) -> str:
        return "fixture"

    def schema(self) -> str:
        return "doc_id long, page int, line_no int, text string, confidence double"

    def reader(self, schema) -> Receipts:
        return Receipts(int(self.options.get("count", 1)), int(self.options.get("partitions", 1)))


SOURCES = {"fixture": Fixture}


def register(spark: SparkSession) -> None:
    for source in SOURCES.values():
        spark.dataSource.register(source)


def lines_of(spark: SparkSession, name: str | None, **options):
    """Lines of a registered source by configured name, without case; the fixture where none or an unknown one is named."""
    register(spark)
    known = (name or "").lower()
    reader = spark.read.format(known if known in SOURCES else "fixture")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
