"""Parquet footers and page headers as rows.

A footer is read by one seek from the end of its file, on executors, one file after another; no data is read. Row: file x row group x leaf column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.sources.locations import data_files, open_file, size_of
from lamina.sources.thrift import Compact

# Names of the numbers in the public Parquet format.
PHYSICAL = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
ENCODINGS = {0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY", 8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT"}
PAGES = ("DATA_PAGE", "INDEX_PAGE", "DICTIONARY_PAGE", "DATA_PAGE_V2")
LOGICAL = {1: "STRING", 2: "MAP", 3: "LIST", 4: "ENUM", 5: "DECIMAL", 6: "DATE", 7: "TIME", 8: "TIMESTAMP", 10: "INTEGER", 11: "UNKNOWN", 12: "JSON", 13: "BSON", 14: "UUID", 15: "FLOAT16"}
CONVERTED = {0: "STRING", 1: "MAP", 3: "LIST", 4: "ENUM", 5: "DECIMAL", 6: "DATE", 7: "TIME", 8: "TIME", 9: "TIMESTAMP", 10: "TIMESTAMP", 11: "INTEGER", 12: "INTEGER", 13: "INTEGER", 14: "INTEGER", 15: "INTEGER", 16: "INTEGER", 17: "INTEGER", 18: "INTEGER", 19: "JSON", 20: "BSON"}
UNITS = {1: "MILLIS", 2: "MICROS", 3: "NANOS"}

CHUNKS = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("file",)), T.StructField("row_group", T.IntegerType()), T.StructField("col_idx", T.IntegerType()),
    *(T.StructField(n, T.StringType()) for n in ("path", "physical_type", "logical_type", "unit")), *(T.StructField(n, T.IntegerType()) for n in ("bit_width", "type_length", "scale", "precision")),
    *(T.StructField(n, T.BooleanType()) for n in ("is_signed", "is_utc")), *(T.StructField(n, T.IntegerType()) for n in ("max_rep_level", "max_def_level", "root_fields", "leaves", "writer_version")),
    T.StructField("created_by", T.StringType()), T.StructField("codec", T.StringType()), T.StructField("encodings", T.ArrayType(T.StringType())),
    T.StructField("encoding_stats", T.ArrayType(T.StructType([T.StructField("page_type", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("count", T.IntegerType())]))),
    *(T.StructField(n, T.LongType()) for n in ("num_values", "rg_rows", "rg_compressed", "compressed", "uncompressed", "null_count", "distinct_count")),
    T.StructField("min", T.BinaryType()), T.StructField("max", T.BinaryType()), *(T.StructField(n, T.BooleanType()) for n in ("min_exact", "max_exact", "has_stats")),
    *(T.StructField(n, T.LongType()) for n in ("dict_offset", "data_offset", "column_index_offset", "bloom_offset")), T.StructField("sorting", T.StringType()), T.StructField("key_values", T.MapType(T.StringType(), T.StringType())),
])

FILES = "file string, size_bytes long, num_rows long, num_row_groups int, num_leaf_columns int, root_fields int, writer_version int, created_by string"
PAGE_ROWS = "file string, row_group int, col_idx int, page int, page_type string, encoding string, num_values long, compressed long, uncompressed long, offset long"


def read_footer(f) -> dict:
    """The decoded FileMetaData of an open file."""
    size = size_of(f)
    f.seek(max(0, size - 65_536))
    tail = f.read(min(size, 65_536))
    if tail[-4:] != b"PAR1" or size < 12:
        raise ValueError("not a Parquet file: it doesn't end in PAR1")
    n = int.from_bytes(tail[-8:-4], "little")
    if n + 8 > size:
        raise ValueError("not a Parquet file: its footer is longer than it")
    if n + 8 > len(tail):
        f.seek(size - 8 - n)
        tail = f.read(n + 8)
    return Compact(tail[-8 - n : -8]).struct()


def _text(x: bytes | None) -> str | None:
    return None if x is None else x.decode("utf-8", "replace")


def leaves(schema: list[dict]) -> list[dict]:
    """Leaf columns in order: path, type and levels."""
    out: list[dict] = []
    at = 1

    def walk(path: tuple[str, ...], repeats: int, defines: int) -> None:
        nonlocal at
        e = schema[at]
        at += 1
        path = (*path, _text(e[4]))
        repeats += e.get(3) == 2
        defines += e.get(3, 0) in (1, 2)
        if e.get(5):
            for _ in range(e[5]):
                walk(path, repeats, defines)
            return
        logical = next(((LOGICAL.get(k), v) for k, v in e.get(10, {}).items()), (CONVERTED.get(e.get(6)), {}))
        kind, about = logical
        converted = e.get(6)
        unit = next((UNITS[k] for k in about.get(2, about.get(1, {})) if k in UNITS), None) if kind in ("TIME", "TIMESTAMP") and isinstance(about.get(2), dict) else {7: "MILLIS", 8: "MICROS", 9: "MILLIS", 10: "MICROS"}.get(converted)
        width = signed = None
        if kind == "INTEGER":
            width, signed = (about[1], about[2]) if about else (8 << (converted - 11) % 4, converted >= 15)
        out.append({
            "path": ".".join(path), "physical_type": PHYSICAL[e[1]], "logical_type": kind, "unit": unit, "bit_width": width, "type_length": e.get(2), "scale": about.get(1, e.get(7)) if kind == "DECIMAL" else None,
            "precision": about.get(2, e.get(8)) if kind == "DECIMAL" else None, "is_signed": signed, "is_utc": (about.get(1) if about else True) if kind in ("TIME", "TIMESTAMP") else None, "max_rep_level": repeats, "max_def_level": defines,
        })

    for _ in range(schema[0].get(5, 0)):
        walk((), 0, 0)
    return out


def chunk_rows(address: str, meta: dict) -> Iterator[dict]:
    """A row for each column chunk of a footer."""
    schema = leaves(meta[2])
    shared = {"file": address, "root_fields": meta[2][0].get(5, 0), "leaves": len(schema), "writer_version": meta.get(1), "created_by": _text(meta.get(6)), "key_values": {_text(kv[1]): _text(kv.get(2)) for kv in meta.get(5, [])}}
    for g, group in enumerate(meta.get(4, [])):
        chunks = group.get(1, [])
        compressed = group.get(6) if group.get(6) is not None else sum(c[3].get(7, 0) for c in chunks)
        sorting = ",".join(f"{s.get(1)}:{int(bool(s.get(2)))}:{int(bool(s.get(3)))}" for s in group[4]) if group.get(4) else None
        for i, c in enumerate(chunks):
            m = c[3]
            s = m.get(12)
            s = s if s is not None else {}
            old = schema[i]["physical_type"] in ("BOOLEAN", "INT32", "INT64", "FLOAT", "DOUBLE")  # of others the deprecated bounds have no defined order
            yield shared | schema[i] | {
                "row_group": g, "col_idx": i, "codec": CODECS[m.get(4, 0)], "encodings": [ENCODINGS.get(e, str(e)) for e in m.get(2, [])],
                "encoding_stats": [{"page_type": PAGES[x[1]], "encoding": ENCODINGS.get(x[2], str(x[2])), "count": x[3]} for x in m[13]] if m.get(13) is not None else None,
                "num_values": m.get(5, 0), "rg_rows": group.get(3, 0), "rg_compressed": compressed, "compressed": m.get(7, 0), "uncompressed": m.get(6, 0), "null_count": s.get(3), "distinct_count": s.get(4),
                "min": s.get(6, s.get(2) if old else None), "max": s.get(5, s.get(1) if old else None), "min_exact": s.get(8), "max_exact": s.get(7), "has_stats": bool(s),
                "dict_offset": m.get(11), "data_offset": m.get(9), "column_index_offset": c.get(6), "bloom_offset": m.get(14), "sorting": sorting,
            }


def page_rows(f, chunk: dict) -> Iterator[dict]:
    """The page headers of a column chunk, in order; page bodies are passed over."""
    at = min(x for x in (chunk["dict_offset"], chunk["data_offset"]) if x)
    end, seen, page = at + chunk["compressed"], 0, 0
    while at < end and seen < chunk["num_values"]:
        f.seek(at)
        data = f.read(min(4096, end - at))
        while True:
            try:
                reader = Compact(data)
                head = reader.struct()
                break
            except IndexError:  # a header with long statistics
                if len(data) >= end - at:
                    return
                f.seek(at)
                data = f.read(min(len(data) * 8, end - at))
        kind = PAGES[head[1]]
        about = head.get({"DATA_PAGE": 5, "DICTIONARY_PAGE": 7, "DATA_PAGE_V2": 8}.get(kind, 6)) or {}
        encoding = ENCODINGS.get(about.get(4 if kind == "DATA_PAGE_V2" else 2))
        n = about.get(1, 0)
        yield {"file": chunk["file"], "row_group": chunk["row_group"], "col_idx": chunk["col_idx"], "page": page, "page_type": kind, "encoding": encoding, "num_values": n, "compressed": head[3], "uncompressed": head[2], "offset": at}
        seen += n if kind.startswith("DATA") else 0
        at += reader.at + head[3]
        page += 1


def _spread(spark: SparkSession, files: Iterable[str]) -> DataFrame:
    """Addresses as rows, a few to each task."""
    names = list(files)
    tasks = max(1, min(len(names), 8 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(n,) for n in names], "file string").repartition(tasks) if names else spark.createDataFrame([], "file string")


def _arrow(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(schema)
    return pa.RecordBatch.from_pylist([{n: list(v.items()) if isinstance(v := r.get(n), dict) else v for n in to.names} for r in rows], to)


def footers(spark: SparkSession, *locations: str) -> DataFrame:
    """The column chunks of all files at locations, with the columns of CHUNKS."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                with open_file(address) as f:
                    rows = list(chunk_rows(address, read_footer(f)))
                for at in range(0, len(rows), 5000):
                    yield _arrow(rows[at : at + 5000], CHUNKS)

    return _spread(spark, data_files(spark, *locations)).mapInArrow(work, CHUNKS)


def files(spark: SparkSession, *locations: str) -> DataFrame:
    """A row for each file at locations, with the columns of FILES; files without row groups have one too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for address in batch.column(0).to_pylist():
                with open_file(address) as f:
                    m, size = read_footer(f), size_of(f)
                rows.append((address, size, m.get(3, 0), len(m.get(4, [])), len(leaves(m[2])), m[2][0].get(5, 0), m.get(1), _text(m.get(6))))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split(" ")[0] for x in FILES.split(", ")])

    return _spread(spark, data_files(spark, *locations)).mapInArrow(work, FILES)


def pages(chunks: DataFrame) -> DataFrame:
    """The page headers of the chunks that rows of footers() name, with the columns of PAGE_ROWS. Where chunks have an address, it is that of the file to read, and file may be another name."""
    schema = T._parse_datatype_string(PAGE_ROWS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                with open_file(chunk["address"]) as f:
                    rows = list(page_rows(f, chunk))
                if rows:
                    yield _arrow(rows, schema)

    address = F.col("address" if "address" in chunks.columns else "file").alias("address")
    return chunks.where("num_values > 0").select(address, "file", "row_group", "col_idx", "dict_offset", "data_offset", "compressed", "num_values").mapInArrow(work, schema)
