"""Scalar functions of layout analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of layouts, in bytes and rows.
MIB = 1 << 20
DICT_PAGE_DEFAULT, DICT_PAGE_MOST = 2 * MIB, 16 * MIB
ROW_GROUP_ROWS, ROW_GROUP_BYTES = 65_536, 256 * MIB
DATA_PAGE_BYTES, VECTOR_PAGE_BYTES, VECTOR_WIDTH = MIB, 256 * 1024, 64
STATISTICS_BYTES = 64


def scale_distinct(distinct: Column, sampled: Column, full: Column) -> Column:
    """Distinct values of a whole column from those of a sample: in proportion, at least what was seen, at most all. Nothing sampled: all."""
    scaled = F.floor(distinct / sampled.cast("double") * full).cast("bigint")
    return F.when((sampled == 0) | (full == 0), full).otherwise(F.least(F.greatest(scaled, distinct), full))


def ratio(compressed: Column, uncompressed: Column) -> Column:
    """Compressed size over uncompressed, null unless both are over 0."""
    return F.when((compressed > 0) & (uncompressed > 0), compressed / uncompressed)


def average(total: Column, n: Column) -> Column:
    """Whole part of the average, 0 of none."""
    return F.when(n > 0, F.floor(total.cast("decimal(38,0)") / n)).otherwise(F.lit(0)).cast("bigint")


def div_ceil(a: Column, b: Column) -> Column:
    """a / b rounded up, null on 0; for decimals beyond bigint."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    whole = F.floor(a / b).cast("decimal(38,0)")
    return F.when(b > 0, F.when(whole * b < a, whole + 1).otherwise(whole).cast("decimal(38,0)"))


def dictionary_payload(distinct: Column, values: Column, size: Column) -> Column:
    """Bytes of a dictionary of so many values, with a quarter to spare: ceil(ceil(size * distinct / values) * 5 / 4); null if any is 0."""
    raw = F.floor((size.cast("decimal(19,0)") * distinct.cast("decimal(19,0)") + values - 1).cast("decimal(38,0)") / values)
    spare = F.floor((raw.cast("decimal(30,0)") * 5 + 3) / 4)
    return F.when((distinct > 0) & (values > 0) & (size > 0), spare.cast("bigint"))


def dictionary_limit(payload: Column) -> Column:
    """The page limit that holds a payload: 2 MiB doubled until it does; 2 MiB if it's unknown."""
    times = F.floor((payload - 1) / DICT_PAGE_DEFAULT).cast("bigint")  # one less than the default limits that hold it
    return F.when(payload.isNull() | (payload <= DICT_PAGE_DEFAULT), F.lit(DICT_PAGE_DEFAULT).cast("bigint")).otherwise((F.lit(DICT_PAGE_DEFAULT) * F.pow(F.lit(2), F.length(F.bin(times)))).cast("bigint"))


def dictionary_rows(rows: Column, limit: Column) -> Column:
    """Rows of a group whose dictionary fits the largest limit: in proportion where the limit is beyond it, one at least."""
    return F.greatest(F.lit(1), F.when(limit > DICT_PAGE_MOST, F.floor(rows.cast("decimal(19,0)") * DICT_PAGE_MOST / limit)).otherwise(rows)).cast("bigint")


def row_group_rows(rows: Column, size: Column) -> Column:
    """Rows of a group of 256 MiB at the same bytes a row, one at least."""
    return F.greatest(F.lit(1), F.floor(rows.cast("decimal(19,0)") * ROW_GROUP_BYTES / size)).cast("bigint")


def percent_change(old: Column, new: Column) -> Column:
    """(new - old) / old * 100, 0 if old is 0."""
    return F.when(old == 0, F.lit(0.0)).otherwise((new - old) / old * 100)


def null_ratio(nulls: Column, values: Column) -> Column:
    """Nulls over values, 0 of none."""
    return F.when(values == 0, F.lit(0.0)).otherwise(nulls / values)


def int_type(logical: Column, physical: Column, width: Column, signed: Column) -> Column:
    """Bit width and sign of an integer column: of its logical type, else of the physical one."""
    own = F.when(physical == "INT32", 32).when(physical == "INT64", 64)
    known = (logical == "INTEGER") & width.isNotNull()
    return F.struct(F.when(known, width).otherwise(own).alias("bit_width"), F.when(known, signed).otherwise(F.lit(True)).alias("is_signed"))


def arrow_type(c) -> Column:
    """Name of the Arrow type of a leaf; c maps names to columns of chunks."""
    physical, logical, unit, utc = c("physical_type"), c("logical_type"), c("unit"), c("is_utc")
    short = F.when(unit == "MILLIS", "ms").when(unit == "MICROS", "us").otherwise("ns")
    zone = F.when(utc, "UTC").otherwise("none")
    decimal = F.concat(F.lit("decimal128("), c("precision").cast("string"), F.lit(","), c("scale").cast("string"), F.lit(")"))
    number = F.concat(F.when(c("is_signed"), "int").otherwise("uint"), c("bit_width").cast("string"))
    stamp = F.concat(F.lit("timestamp("), short, F.lit(","), zone, F.lit(")"))
    in_32 = F.when(logical == "INTEGER", number).when(logical == "DATE", "date32").when(logical == "DECIMAL", decimal).when(logical == "TIME", "time32(ms)").otherwise("int32")
    in_64 = F.when(logical == "INTEGER", number).when(logical == "TIMESTAMP", stamp).when(logical == "TIME", F.concat(F.lit("time64("), short, F.lit(")"))).when(logical == "DECIMAL", decimal).otherwise("int64")
    in_bytes = F.when(logical.isin("STRING", "ENUM", "JSON"), "utf8").when(logical == "DECIMAL", decimal).otherwise("binary")
    in_fixed = F.when(logical == "DECIMAL", decimal).otherwise(F.concat(F.lit("fixed_size_binary("), c("type_length").cast("string"), F.lit(")")))
    return (
        F.when(physical == "BOOLEAN", "boolean").when(physical == "INT32", in_32).when(physical == "INT64", in_64).when(physical == "INT96", "timestamp(ns,none)")
        .when(physical == "FLOAT", "float32").when(physical == "DOUBLE", "float64").when(physical == "BYTE_ARRAY", in_bytes).otherwise(in_fixed)
    )


def kind(physical: Column, logical: Column) -> Column:
    """The kind of statistics that a leaf has."""
    text = logical.isin("STRING", "ENUM", "JSON", "BSON")
    return (
        F.when(physical == "BOOLEAN", "boolean").when(physical.isin("INT32", "INT64"), "int").when(physical.isin("FLOAT", "DOUBLE"), "float")
        .when((physical == "BYTE_ARRAY") & F.coalesce(text, F.lit(False)), "string").when(physical == "BYTE_ARRAY", "binary").when(physical == "FIXED_LEN_BYTE_ARRAY", "fixed").otherwise("unknown")
    )


def is_text(logical: Column, path: Column) -> Column:
    """Whether a byte column holds text: by its logical type, else unless its name says bytes, embedding or image."""
    low = F.lower(path)
    return F.coalesce(logical.isin("STRING", "JSON", "ENUM", "BSON"), F.lit(False)) | ~(low.contains("bytes") | low.contains("embedding") | low.contains("image"))


def is_text_logical(logical: Column) -> Column:
    """Whether the logical type is String, Json or Enum."""
    return F.coalesce(logical.isin("STRING", "JSON", "ENUM"), F.lit(False))


def suits_zstd(physical: Column, logical: Column) -> Column:
    """Whether a column of the type may gain by ZSTD."""
    return physical.isin("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY") | (physical.isin("INT32", "INT64") & is_text_logical(logical))


def has(encodings: Column, *names: str) -> Column:
    """Whether any of the encodings is listed."""
    return F.arrays_overlap(encodings, F.array(*map(F.lit, names)))
