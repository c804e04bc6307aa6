"""Python data sources: spark.read.format("parquet_footer" | "parquet_pages" | "parquet_sample").option("path", ...).

Each takes files, one partition a file, and reads footers, page headers or a bounded sample of rows where the executor opens the file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lamina.sources.footer import CHUNKS, PAGE_ROWS, _arrow, chunk_rows, page_rows, read_footer
from lamina.sources.locations import open_file, resolve

#: Rows that a sample of a file has at most: the first of its first row group with rows.
SAMPLE_ROWS = 16_384


def _files(options: dict) -> list[str]:
    path = options.get("path") or options.get("paths")
    if not path:
        raise ValueError("the option path names the files")
    names = json.loads(path) if path.startswith("[") else [path]
    out = []
    for name in names:
        address = resolve(name)
        if address.startswith("file://"):
            import os

            inner = address.removeprefix("file://")
            if os.path.isdir(inner):
                out += ["file://" + os.path.join(d, x) for d, _, xs in sorted(os.walk(inner)) for x in sorted(xs) if not x.startswith(("_", "."))]
                continue
        out.append(address)
    return out


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.options)]


class _FooterReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open_file(partition.value) as f:
            rows = list(chunk_rows(partition.value, read_footer(f)))
        if rows:
            yield _arrow(rows, CHUNKS)


class _PagesReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open_file(partition.value) as f:
            for chunk in chunk_rows(partition.value, read_footer(f)):
                if chunk["num_values"] and (rows := list(page_rows(f, chunk))):
                    yield _arrow(rows, self.schema)


class _SampleReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from lamina.sources.sample import sample_batches, spark_schema

        names = [f.name for f in self.schema.fields]
        for batch in sample_batches(partition.value, names, int(self.options.get("rows", SAMPLE_ROWS))):
            yield pa.Table.from_batches([batch]).cast(spark_schema(batch.schema)).combine_chunks().to_batches()[0]


class FooterSource(DataSource):
    """Column chunks of footers."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footer"

    def schema(self) -> StructType:
        return CHUNKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FooterReader(schema, self.options)


class PagesSource(DataSource):
    """Page headers of all chunks."""

    @classmethod
    def name(cls) -> str:
        return "parquet_pages"

    def schema(self) -> str:
        return PAGE_ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagesReader(schema, self.options)


class SampleSource(DataSource):
    """The first rows of the first row group with rows; other row groups aren't read."""

    @classmethod
    def name(cls) -> str:
        return "parquet_sample"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        from lamina.sources.sample import arrow_schema, spark_schema

        return from_arrow_schema(spark_schema(arrow_schema(_files(self.options)[0])))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SampleReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    for source in (FooterSource, PagesSource, SampleSource):
        spark.dataSource.register(source)
