"""Profiles of leaf columns: sizes, nulls, bounds, byte lengths and numbers of distinct values, over footers, pages and data."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.layout import arrow_type, int_type, kind, null_ratio, scale_distinct
from lamina.sources.datasource import SAMPLE_ROWS
from lamina.sources.footer import pages
from lamina.sources.sample import sample_batches

KEY = ["file", "col_idx"]


def non_null(values: str = "num_values", nulls: str = "null_count") -> Column:
    """Values that aren't null; missing counts of nulls are 0, larger ones than values all."""
    return F.greatest(F.col(values) - F.coalesce(F.col(nulls), F.lit(0)), F.lit(0))


def column_totals(chunks: DataFrame) -> DataFrame:
    """For each file and leaf column: types, values, nulls, sizes and row groups, summed over its chunks."""
    first = lambda c: F.min_by(c, "row_group").alias(c)
    same = ("path", "physical_type", "logical_type", "unit", "bit_width", "type_length", "scale", "precision", "is_signed", "is_utc", "max_rep_level", "max_def_level", "root_fields", "leaves")
    return chunks.groupBy(*KEY).agg(
        *(first(c) for c in same), F.sum("num_values").alias("num_values"), F.sum(F.coalesce("null_count", F.lit(0))).alias("null_count"), F.sum("uncompressed").alias("uncompressed"),
        F.sum("compressed").alias("compressed"), F.sum(non_null()).alias("non_null_count"), F.count("*").cast("int").alias("row_groups"),
        # What the chunks of a column have between them.
        F.max("rg_rows").alias("max_rg_rows"),
    )


def file_totals(chunks: DataFrame) -> DataFrame:
    """For each file: rows, row groups, leaf columns and sizes of its row groups."""
    groups = chunks.groupBy("file", "row_group").agg(F.max("rg_rows").alias("rows"), F.max("rg_compressed").alias("size"), F.max("leaves").alias("leaves"))
    return groups.groupBy("file").agg(F.sum("rows").alias("num_rows"), F.count("*").cast("int").alias("num_row_groups"), F.max("leaves").alias("num_leaf_columns"), F.sum("size").alias("compressed"))


# The bounds of statistics are little-endian bytes of the physical type: numbers are unpacked where rows are made, on executors.
_BOUNDS = "file string, col_idx int, row_group int, int_min long, int_max long, float_min double, float_max double, bool_min boolean, bool_max boolean, text_min string, text_max string, bytes_min binary, bytes_max binary"
_FORMATS = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = _BOUNDS.split(", ")
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    for batch in batches:
        rows = []
        for file, col, group, physical, what, low, high, low_exact, high_exact in zip(*(batch.column(i).to_pylist() for i in range(9))):
            out = dict.fromkeys(x.split(" ")[0] for x in fields) | {"file": file, "col_idx": col, "row_group": group}
            for side, value, exact in (("min", low, low_exact), ("max", high, high_exact)):
                if value is None:
                    continue
                if physical in _FORMATS and len(value) == struct.calcsize(_FORMATS[physical]):
                    number = struct.unpack(_FORMATS[physical], value)[0]
                    out[f"{'int' if physical.startswith('INT') else 'float'}_{side}"] = number
                elif physical == "BOOLEAN":
                    out[f"bool_{side}"] = value[:1] == b"\x01"
                elif physical == "BYTE_ARRAY" and exact:
                    out[f"bytes_{side}"] = value
                    if what == "string":
                        try:
                            out[f"text_{side}"] = value.decode()
                        except UnicodeDecodeError:
                            pass
            rows.append(out)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in fields]))


def footer_bounds(chunks: DataFrame) -> DataFrame:
    """Smallest and largest value of each file and leaf column by the statistics of its chunks: exact bounds alone for bytes, in byte order."""
    named = chunks.where("min IS NOT NULL OR max IS NOT NULL").select(*KEY, "row_group", "physical_type", kind(F.col("physical_type"), F.col("logical_type")).alias("kind"), "min", "max", "min_exact", "max_exact")
    values = [x.split(" ")[0] for x in _BOUNDS.split(", ")[3:]]
    return named.mapInArrow(_unpacked, _BOUNDS).groupBy(*KEY).agg(*(getattr(F, v.rsplit("_", 1)[1])(v).alias(v) for v in values))


def _leaf_names(schema: pa.Schema) -> list[tuple[str, ...]]:
    """Names of the leaves under each top field, in order."""
    out: list[tuple[str, ...]] = []

    def walk(field: pa.Field, path: tuple[str, ...]) -> None:
        t = field.type
        if pa.types.is_struct(t):
            for i in range(t.num_fields):
                walk(t.field(i), (*path, t.field(i).name))
        elif pa.types.is_map(t):
            walk(t.key_field, (*path, "key"))
            walk(t.item_field, (*path, "value"))
        elif pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
            walk(t.value_field, (*path, "element"))
        else:
            out.append(path)

    for f in schema:
        walk(f, (f.name,))
    return out


_SAMPLED = "file string, col_idx int, sampled long, distinct long, int_min long, int_max long, float_min double, float_max double, bool_min boolean, bool_max boolean, text_min string, text_max string, bytes_min binary, bytes_max binary, length_min long, length_max long, length_avg double"
_HASHED = _SAMPLED + ", length_sum long, hashes array<long>"


def _hashes(values: pa.Array) -> list[int]:
    """64-bit hashes of values: numbers as such, others by their bytes."""
    from hashlib import blake2b

    of = lambda x: int.from_bytes(blake2b(x if isinstance(x, bytes) else repr(x).encode(), digest_size=8).digest(), "little", signed=True)
    return [int(x) if isinstance(x, int) and -(1 << 63) <= x < 1 << 63 else of(x) for x in values.to_pylist()]


def _profile_sample(address: str, rows: int, across: bool = False) -> list[dict]:
    """What the first rows of a flat file say of its columns: a list of values counts each row as its own. Across row groups, with hashes of the distinct values."""
    import pyarrow.compute as pc

    from lamina.sources.sample import arrow_schema

    schema = arrow_schema(address)
    out = []
    if len(_leaf_names(schema)) != len(schema):
        return out  # nested: rows don't line up with leaves
    table = pa.Table.from_batches(sample_batches(address, schema.names, rows, across), schema)
    names = [x.split(" ")[0] for x in (_HASHED if across else _SAMPLED).split(", ")]
    for i, name in enumerate(schema.names):
        column = table.column(name).combine_chunks().drop_null() if len(table) else table.column(name)
        row = dict.fromkeys(names) | {"file": address, "col_idx": i, "sampled": len(column)}
        t = column.type
        if pa.types.is_nested(t):
            row["distinct"] = len(column)
        elif pa.types.is_floating(t):  # by bits, so that zeros of either sign and NaNs of other bits differ
            bits = column.view({16: pa.int16(), 32: pa.int32(), 64: pa.int64()}[t.bit_width]) if isinstance(column, pa.Array) else column
            distinct = pc.unique(bits)
        else:
            distinct = pc.unique(column)
        if not pa.types.is_nested(t):
            row["distinct"] = len(distinct)
            if across:
                whole = {32: pa.int32(), 64: pa.int64()}.get(t.bit_width) if pa.types.is_temporal(t) else pa.large_binary() if pa.types.is_string(t) or pa.types.is_large_string(t) else None
                row["hashes"] = _hashes(distinct.cast(whole) if whole else distinct)
        if len(column) and not pa.types.is_nested(t):
            if pa.types.is_floating(t):
                numbers = column.filter(pc.invert(pc.is_nan(column)))
                if len(numbers):
                    row["float_min"], row["float_max"] = (float(pc.call_function(f, [numbers]).as_py()) for f in ("min", "max"))
            elif pa.types.is_boolean(t):
                row["bool_min"], row["bool_max"] = pc.min(column).as_py(), pc.max(column).as_py()
            elif pa.types.is_integer(t):
                row["int_min"], row["int_max"] = (min(pc.call_function(f, [column]).as_py(), (1 << 63) - 1) for f in ("min", "max"))
            elif pa.types.is_temporal(t):
                whole = column.cast(pa.int32() if t.bit_width == 32 else pa.int64())
                row["int_min"], row["int_max"] = pc.min(whole).as_py(), pc.max(whole).as_py()
            elif pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_binary(t) or pa.types.is_large_binary(t):
                raw = column.cast(pa.large_binary())
                row["bytes_min"], row["bytes_max"] = pc.min(raw).as_py(), pc.max(raw).as_py()
                if pa.types.is_string(t) or pa.types.is_large_string(t):
                    row["text_min"], row["text_max"] = row["bytes_min"].decode(), row["bytes_max"].decode()
                sizes = pc.binary_length(raw)
                row["length_min"], row["length_max"], row["length_avg"] = pc.min(sizes).as_py(), pc.max(sizes).as_py(), pc.mean(sizes).as_py()
                if across:
                    row["length_sum"] = pc.sum(sizes).as_py()
        out.append(row)
    return out


def sampled(files: DataFrame, rows: int = SAMPLE_ROWS, across: bool = False) -> DataFrame:
    """For each flat file (column file) and leaf column what a sample of its first rows says; one row group of a file is read, from its start, or across row groups as many as have these rows. Nested files have no rows.

    Across row groups, length_sum and hashes of the distinct values are added, by which samples are put together."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    shape = _HASHED if across else _SAMPLED

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                if found := _profile_sample(address, rows, across):
                    yield pa.RecordBatch.from_pylist(found, pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in shape.split(", ")]))

    return files.select("file").mapInArrow(work, T._parse_datatype_string(shape))


def samples_together(samples: DataFrame) -> DataFrame:
    """Samples across row groups with one file and col_idx as one: their values are counted together, distinct ones by hash (lists each as its own)."""
    ends = [x.split(" ")[0] for x in _SAMPLED.split(", ") if x.split(" ")[0].endswith(("_min", "_max"))]
    sums = samples.groupBy(*KEY).agg(
        F.sum("sampled").alias("sampled"), F.sum(F.when(F.col("hashes").isNull(), F.col("distinct"))).alias("lists"), *(getattr(F, n.rsplit("_", 1)[1])(n).alias(n) for n in ends),
        (F.sum("length_sum") / F.sum(F.when(F.col("length_sum").isNotNull(), F.col("sampled")))).alias("length_avg"),
    )
    values = samples.select(*KEY, F.explode("hashes").alias("h")).distinct().groupBy(*KEY).agg(F.count("*").alias("values"))
    return sums.join(values, KEY, "left").withColumn("distinct", F.coalesce("lists", "values", F.lit(0))).drop("lists", "values")


def cardinality(chunks: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(file, col_idx, distinct_count, non_null_count, tier): the estimated number of distinct values of each leaf column.

    By the first that applies to the first row group with rows: (1) the statistics' own count, (2) the values of the chunk's dictionary page, both scaled to the whole column; (3) of flat files distinct
    values of a sample of rows, scaled by sampled values; (4) all values that aren't null. Data is sampled only of files with columns that (1) and (2) leave open. Files without row groups have no rows."""
    totals = chunks.groupBy(*KEY).agg(
        F.sum(non_null()).alias("total"), F.coalesce(F.min(F.when(F.col("rg_rows") > 0, F.col("row_group"))), F.lit(0)).alias("__g")
    )
    first = chunks.join(totals, KEY).where("row_group = __g").withColumn("seen", non_null())
    dictionary = pages(first.where("dict_offset IS NOT NULL OR data_offset IS NOT NULL")).where("page = 0 AND page_type = 'DICTIONARY_PAGE'").select(*KEY, F.col("num_values").alias("dict_values"))
    known = first.join(dictionary, KEY, "left")
    one = F.when(F.col("distinct_count").isNotNull(), scale_distinct(F.least("distinct_count", "seen"), F.col("seen"), F.col("total")))
    least = F.least("dict_values", "total")
    two = F.when(F.col("dict_values").isNotNull(), F.greatest(scale_distinct(F.col("dict_values"), F.col("seen"), F.col("total")), least))
    tiers = known.select(*KEY, "total", "seen", "root_fields", "leaves", F.when(F.col("seen") > 0, one).alias("one"), F.when((F.col("seen") > 0) & two.isNotNull(), F.least(two, "total")).alias("two"))
    open_files = tiers.where("one IS NULL AND two IS NULL AND root_fields = leaves").select("file").distinct()
    samples = sampled(open_files, rows).select(*KEY, "sampled", F.col("distinct").alias("sample_distinct"))
    placed = tiers.join(samples, KEY, "left")
    three = F.when(F.col("sampled") > 0, scale_distinct(F.col("sample_distinct"), F.col("sampled"), F.col("total")))
    tier = F.when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).when(three.isNotNull(), 3).otherwise(4)
    return placed.select(*KEY, F.coalesce("one", "two", three, "total").cast("bigint").alias("distinct_count"), F.col("total").cast("bigint").alias("non_null_count"), tier.alias("tier"))


def cardinality_ratio(distinct: Column, count: Column) -> Column:
    """Distinct values over those that aren't null, 0 of none."""
    return F.when(count == 0, F.lit(0.0)).otherwise(distinct / count)


def columns(chunks: DataFrame, rows: int = SAMPLE_ROWS, exact: DataFrame | None = None) -> DataFrame:
    """The full profile of each leaf column: types, totals, distinct values, and by kind bounds and byte lengths, from statistics and where these lack them from a sample.

    exact has what all values say, to stand in place of statistics, estimates and samples: distinct_count, non_null_count, the bounds and the lengths by file and col_idx; columns that it lacks have none of these."""
    c = F.col
    totals = column_totals(chunks).withColumn("kind", kind(c("physical_type"), c("logical_type")))
    if exact is None:
        flat = totals.where("root_fields = leaves").select("file").distinct()
        names = [x.split(" ")[0] for x in _BOUNDS.split(", ")[3:]]
        sample = sampled(flat, rows).select(*KEY, *(c(n).alias(f"s_{n}") for n in names), "length_min", "length_max", "length_avg")
        joined = totals.drop("non_null_count").join(cardinality(chunks, rows), KEY, "left").join(footer_bounds(chunks), KEY, "left").join(sample, KEY, "left")
        value = lambda n: F.coalesce(n, f"s_{n}")
    else:
        joined = totals.drop("non_null_count").join(exact, KEY, "left").withColumn("null_count", F.coalesce(c("num_values") - c("non_null_count"), c("null_count")))
        value = c
    lengths = F.struct(c("length_min").alias("min"), c("length_max").alias("max"), c("length_avg").alias("avg"))
    pair = lambda n, *more: F.struct(value(f"{n}_min").alias("min"), value(f"{n}_max").alias("max"), *more)
    of = lambda k, s: F.when(c("kind") == k, s)
    width = int_type(c("logical_type"), c("physical_type"), c("bit_width"), c("is_signed"))
    return joined.select(
        *KEY, "path", "physical_type", "logical_type", arrow_type(c).alias("arrow_type"), "max_rep_level", "kind", "num_values", "null_count", null_ratio(c("null_count"), c("num_values")).alias("null_ratio"), "distinct_count",
        "non_null_count", cardinality_ratio(c("distinct_count"), c("non_null_count")).alias("cardinality_ratio"), "uncompressed", "compressed",
        of("int", pair("int", width["bit_width"].alias("bit_width"), width["is_signed"].alias("is_signed"))).alias("int_stats"), of("float", pair("float")).alias("float_stats"), of("boolean", pair("bool")).alias("boolean_stats"),
        of("string", pair("text", lengths.alias("lengths"))).alias("string_stats"), of("binary", pair("bytes", lengths.alias("lengths"))).alias("binary_stats"), of("fixed", F.struct("type_length")).alias("fixed_stats"),
    )


def value_profile(df: DataFrame, *names: str) -> DataFrame:
    """For columns of data: (column, num_values, non_null, distinct, min_length, max_length, avg_length), exact (but that 64-bit hashes of distinct values are taken to differ); lengths in bytes of strings and binaries.

    One pass over the data: what is shuffled is a hash for each distinct value, counted before it goes out, and no values."""
    rows = []
    for n in names or df.columns:
        x = F.col(f"`{n}`")
        size = F.octet_length(x) if isinstance(df.schema[n].dataType, (T.StringType, T.BinaryType)) else F.lit(None)
        rows.append(F.struct(F.lit(n).alias("column"), F.when(x.isNotNull(), F.xxhash64(x)).alias("h"), size.cast("bigint").alias("size")))
    values = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    by_value = values.groupBy("column", "h").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.sum("size").alias("sum"), F.count("size").alias("sized"))
    known = F.col("h").isNotNull()
    found = by_value.groupBy("column").agg(
        F.sum("n").alias("num_values"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"), F.count("h").alias("distinct"), F.min("lo").alias("min_length"), F.max("hi").alias("max_length"),
        (F.sum("sum") / F.sum("sized")).alias("avg_length"),
    )
    columns = df.sparkSession.createDataFrame([(n,) for n in names or df.columns], "column string")
    return columns.join(F.broadcast(found), "column", "left").select("column", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("num_values", "non_null", "distinct")), "min_length", "max_length", "avg_length")


def value_cardinality(df: DataFrame) -> DataFrame:
    """(column, distinct_count, non_null_count) of all columns of data, counted; of lists their elements count."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    flat = [n for n in df.columns if n not in lists]
    parts = ([value_profile(df, *flat)] if flat else []) + [value_profile(df.select(F.explode(f"`{n}`").alias(n)), n) for n in lists]
    return reduce(DataFrame.unionByName, parts).select("column", F.col("distinct").alias("distinct_count"), F.col("non_null").alias("non_null_count"))


def value_bounds(df: DataFrame, *names: str) -> DataFrame:
    """For columns of data: (column, int_min, int_max, float_min, ..., bytes_max), exact, by kind; times in microseconds, dates in days, texts in byte order, a zero of either sign as 0.0, NaN as the largest number.

    One pass over the data; a row for each task is shuffled."""
    names = names or tuple(df.columns)
    ends = df.agg(*(getattr(F, side)(f"`{n}`").alias(f"{side}{i}") for i, n in enumerate(names) for side in ("min", "max")))
    kinds = {"int": "bigint", "float": "double", "bool": "boolean", "text": "string", "bytes": "binary"}

    def shown(x: str, of: T.DataType) -> tuple[str | None, Column]:
        if isinstance(of, (T.FloatType, T.DoubleType)):
            return "float", F.col(x).cast("double") + F.lit(0.0)
        if isinstance(of, T.IntegralType):
            return "int", F.col(x)
        if isinstance(of, T.DateType):
            return "int", F.unix_date(x)
        if isinstance(of, T.TimestampType):
            return "int", F.unix_micros(x)
        if isinstance(of, T.TimestampNTZType):
            return "int", F.expr(f"CAST({x} - TIMESTAMP_NTZ'1970-01-01' AS DECIMAL(20, 6)) * 1000000")  # without a time zone
        return {T.BooleanType: "bool", T.StringType: "text", T.BinaryType: "bytes"}.get(type(of)), F.col(x)

    rows = []
    for i, n in enumerate(names):
        found = {side: shown(f"{side}{i}", df.schema[n].dataType) for side in ("min", "max")}
        rows.append(F.struct(F.lit(n).alias("column"), *((found[s][1] if found[s][0] == k else F.lit(None)).cast(t).alias(f"{k}_{s}") for k, t in kinds.items() for s in ("min", "max"))))
    return ends.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def prefix_cardinality(spark: SparkSession, location: str, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(distinct, sampled, total, scaled): the sampled estimate of one column of a file by Spark's row index, exact as to which rows are the first."""
    data = spark.read.parquet(location).select(F.col(f"`{column}`").alias("v"), F.col("_metadata.row_index").alias("i"))
    total = F.count("v")
    part = F.when(F.col("i") < rows, F.col("v"))
    one = data.agg(F.count_distinct(part).alias("distinct"), F.count(part).alias("sampled"), total.alias("total"))
    return one.select("distinct", "sampled", "total", scale_distinct(F.col("distinct"), F.col("sampled"), F.col("total")).alias("scaled"))
