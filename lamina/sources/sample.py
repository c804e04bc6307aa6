"""A bounded sample of a file: its first row group with rows, read from its start, chosen columns only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq

from lamina.sources.locations import open_file


def arrow_schema(address: str) -> pa.Schema:
    """The file's Arrow schema."""
    with open_file(address) as f:
        return pq.ParquetFile(f).schema_arrow


def spark_schema(schema: pa.Schema) -> pa.Schema:
    """The schema with types that Spark has: unsigned numbers as wider signed ones, as Spark reads them."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    return pa.schema([f.with_type(wider.get(f.type, f.type)) for f in schema])


def sample_batches(address: str, columns: list[str], rows: int, across: bool = False) -> Iterator[pa.RecordBatch]:
    """At most so many rows of the first row group with rows (of none, nothing), or of the file across its row groups."""
    with open_file(address) as f:
        file = pq.ParquetFile(f)
        groups = [g for g in range(file.num_row_groups) if file.metadata.row_group(g).num_rows]
        left = rows
        for batch in file.iter_batches(batch_size=min(8192, rows), row_groups=groups if across else groups[:1], columns=columns) if groups else ():
            yield (part := batch.slice(0, left))
            left -= len(part)
            if left <= 0:
                return
