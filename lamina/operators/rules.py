"""The catalogue of layout rules: each is an aggregation of column chunks to findings.

A rule takes Inputs and returns rows (file, rule, rule_ord, severity, severity_ord, location, message, directives); location is a struct of kind, index and path, directives
an array of structs of scope, path, property and value. Rules that need no estimate of distinct values don't cause one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.layout import (
    DATA_PAGE_BYTES, DICT_PAGE_MOST, MIB, ROW_GROUP_BYTES, ROW_GROUP_ROWS, STATISTICS_BYTES, VECTOR_PAGE_BYTES, VECTOR_WIDTH, average, dictionary_limit, dictionary_payload, dictionary_rows, has, is_text,
    is_text_logical, ratio, row_group_rows, suits_zstd,
)
from lamina.operators.profile import KEY, cardinality, cardinality_ratio
from lamina.sources.footer import pages

SEVERITIES = ("suggestion", "warning", "error")

#: What a finding has.
FINDING = ("file", "rule", "rule_ord", "severity", "severity_ord", "location", "message", "directives")


@dataclass
class Inputs:
    """Column chunks, and the estimates of distinct values, made when a rule first asks for them."""

    chunks: DataFrame
    sample_rows: int = 16_384
    distinct: DataFrame | None = None

    @cached_property
    def cardinality(self) -> DataFrame:
        found = self.distinct if self.distinct is not None else cardinality(self.chunks, self.sample_rows)
        return found.withColumn("ratio", cardinality_ratio(F.col("distinct_count"), F.col("non_null_count"))).cache()  # a row for each column; two rules read it


Rule = Callable[[Inputs], DataFrame]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    """Enter a rule in the catalogue; the order of entries is the order of rules."""

    def enter(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return enter


def directive(scope: str, path: Column | None, name: str, value: Column | str | int | bool) -> Column:
    """A directive as a struct."""
    shown = value if isinstance(value, Column) else F.lit(str(value).lower() if isinstance(value, bool) else str(value))
    return F.struct(F.lit(scope).alias("scope"), (path if path is not None else F.lit(None)).cast("string").alias("path"), F.lit(name).alias("property"), shown.cast("string").alias("value"))


def _finding(df: DataFrame, name: str, severity: Column | str, message: Column, *directives: Column, of_file: bool = False) -> DataFrame:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    order = F.when(level == "error", 2).when(level == "warning", 1).otherwise(0)
    at = F.struct(F.lit("file" if of_file else "column").alias("kind"), (F.lit(None).cast("int") if of_file else F.col("col_idx")).alias("index"), (F.lit(None).cast("string") if of_file else F.col("path")).alias("path"))
    wanted = directives[0] if len(directives) == 1 and not isinstance(directives[0], tuple) else F.array(*directives)
    return df.select("file", F.lit(name).alias("rule"), F.lit(list(RULES).index(name)).alias("rule_ord"), level.alias("severity"), order.alias("severity_ord"), at.alias("location"), message.alias("message"), wanted.alias("directives"))


def _some(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def _first(*names: str) -> list[Column]:
    return [F.min_by(n, "row_group").alias(n) for n in names]


# -- aggregates, each also a result of its own ------------------------------------------------------------------------


def compression_ratios(chunks: DataFrame) -> DataFrame:
    """Ratio of each column over its compressed chunks, and the codec of the last of them."""
    good = (F.col("codec") != "UNCOMPRESSED") & (F.col("uncompressed") > 0)
    return chunks.where(good).groupBy(*KEY).agg(*_first("path"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"), F.max_by("codec", "row_group").alias("codec")).withColumn("ratio", F.col("compressed") / F.col("uncompressed"))


def missing_page_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks of each column without a column index, and all."""
    return chunks.groupBy(*KEY).agg(*_first("path"), _count(F.col("column_index_offset").isNull()).alias("missing"), F.count("*").alias("total"))


def vector_widths(chunks: DataFrame) -> DataFrame:
    """Values a row of repeated float columns, over row groups with rows."""
    floats = F.col("physical_type").isin("FLOAT", "DOUBLE") & (F.col("max_rep_level") > 0) & (F.col("rg_rows") > 0)
    return chunks.where(floats).groupBy(*KEY).agg(*_first("path"), F.sum("num_values").alias("v"), F.sum("rg_rows").alias("r")).select(*KEY, "path", average(F.col("v"), F.col("r")).alias("avg_values"))


def row_group_policy(chunks: DataFrame) -> DataFrame:
    """Row groups of each file beyond the limits of rows and bytes, and the rows that keep to both."""
    groups = chunks.groupBy("file", "row_group").agg(F.max("rg_rows").alias("rows"), F.max("rg_compressed").alias("size"))
    many, big = F.col("rows") > ROW_GROUP_ROWS, F.col("size") > ROW_GROUP_BYTES
    return groups.groupBy("file").agg(
        F.count("*").alias("groups"), _count(many).alias("oversized_rows"), _count(big).alias("oversized_bytes"),
        F.least(F.lit(ROW_GROUP_ROWS).cast("bigint"), F.min(F.when(big, row_group_rows(F.col("rows"), F.col("size"))))).alias("target_rows"),
    )


def string_summary(chunks: DataFrame) -> DataFrame:
    """Sizes of byte columns over non-empty chunks, with the ratio and average chunk, and what encodings they have."""
    c, full = F.col, F.col("uncompressed") > 0
    e = c("encodings")
    found = chunks.where("physical_type = 'BYTE_ARRAY'").groupBy(*KEY).agg(
        *_first("path", "logical_type"), F.sum("uncompressed").alias("uncompressed"), F.sum("compressed").alias("compressed"), _count(full).alias("groups"), _some(has(e, "PLAIN")).alias("plain"),
        _some(has(e, "PLAIN_DICTIONARY", "RLE_DICTIONARY")).alias("dictionary"), _some(has(e, "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY")).alias("delta"),
    )
    return found.withColumn("ratio", ratio(c("compressed"), c("uncompressed"))).withColumn("average", average(c("uncompressed"), c("groups")))


def codec_votes(chunks: DataFrame) -> DataFrame:
    """Chunks of each column that would gain by ZSTD and by LZ4, with what decides between them."""
    c = F.col
    fast = (c("codec") == "SNAPPY") & (c("uncompressed") > 4 * MIB)
    full = c("uncompressed") > 0
    found = chunks.groupBy(*KEY).agg(
        *_first("path", "physical_type", "logical_type"), F.sum("uncompressed").alias("uncompressed"), F.sum("compressed").alias("compressed"), F.count("*").alias("n"), _count(full).alias("m"),
        F.min_by("codec", "row_group").alias("codec0"), F.min_by("codec", F.when(full, c("row_group"))).alias("full_codec"), _count(fast).alias("lz4"), _count(~fast).alias("zstd"),
    )
    found = found.withColumn("ratio", ratio(c("compressed"), c("uncompressed"))).withColumn("average", average(c("uncompressed"), c("m")))
    r, total = F.coalesce("ratio", F.lit(0.0)), c("uncompressed")
    no_zstd = (total < 8 * MIB) | ~suits_zstd(c("physical_type"), c("logical_type")) | ((c("n") == 1) & (total < 32 * MIB)) | ((c("codec0") == "SNAPPY") & (r >= 0.90)) | (r > 0.95)
    no_lz4 = (is_text_logical(c("logical_type")) & (total < 32 * MIB)) | (r > 0.98)
    small = (c("physical_type") == "BYTE_ARRAY") & (c("full_codec") == "SNAPPY") & (c("m") >= 64) & (total >= 64 * MIB) & (c("average") > 0) & (c("average") <= MIB) & r.between(0.55, 0.85)
    voted = found.withColumn("zstd", F.when(no_zstd, 0).otherwise(c("zstd"))).withColumn("lz4", F.when(no_lz4, 0).otherwise(c("lz4"))).withColumn("small_chunks", F.coalesce(small, F.lit(False)))
    target = F.when(c("small_chunks"), "lz4_raw").when(c("lz4") > c("zstd"), "lz4_raw").when(c("zstd") > 0, "zstd(3)").when(c("lz4") > 0, "lz4_raw")
    return voted.withColumn("target", target)


def plain_groups(chunks: DataFrame, better: str, condition: Column) -> DataFrame:
    """Non-empty chunks of the columns that list PLAIN and not a better encoding."""
    e = F.col("encodings")
    want = (F.col("num_values") > 0) & has(e, "PLAIN") & ~has(e, better)
    return chunks.where(condition).groupBy(*KEY).agg(*_first("path"), _count(want).alias("groups"))


def statistics_peaks(chunks: DataFrame) -> DataFrame:
    """Longest exact bounds of byte columns."""
    exact = chunks.where("physical_type = 'BYTE_ARRAY' AND min_exact")
    return exact.groupBy(*KEY).agg(*_first("path"), F.max(F.octet_length("min")).alias("peak_min"), F.max(F.octet_length("max")).alias("peak_max"))


def dictionary_states(chunks: DataFrame) -> DataFrame:
    """How each chunk uses its dictionary: NoDictionary, Fallback, DictionaryOnly or Unknown, by its listed encodings and the encodings of its data pages; where those aren't counted
    the page headers of one in twenty such chunks of a column, evenly spaced and one at least, are read."""
    e, stats = F.col("encodings"), F.col("encoding_stats")
    data = F.filter(stats, lambda s: s["page_type"].isin("DATA_PAGE", "DATA_PAGE_V2") & (s["count"] > 0))
    of = lambda x, *names: F.exists(x, lambda s: s["encoding"].isin(*names))
    dictionary, plain = of(data, "PLAIN_DICTIONARY", "RLE_DICTIONARY"), F.exists(data, lambda s: ~s["encoding"].isin("PLAIN_DICTIONARY", "RLE_DICTIONARY"))
    by_pages = _state(dictionary, plain)
    state = F.when(~has(e, "PLAIN_DICTIONARY", "RLE_DICTIONARY"), "NoDictionary").when(stats.isNotNull(), by_pages).when(has(e, "PLAIN"), "Unknown").otherwise("DictionaryOnly")
    first = chunks.withColumn("state", state)
    from pyspark.sql import Window

    unknown = first.where("state = 'Unknown' AND encoding_stats IS NULL")
    w = Window.partitionBy(*KEY)
    placed = unknown.withColumn("i", F.row_number().over(w.orderBy("row_group")) - 1).withColumn("n", F.count("*").over(w)).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") / 20)))
    # Place floor(j * n / k) of the j-th of k samples.
    j = F.ceil(F.col("i") * F.col("k") / F.col("n"))
    chosen = placed.where((j < F.col("k")) & (F.floor(j * F.col("n") / F.col("k")) == F.col("i"))).drop("i", "n", "k")
    read = pages(chosen).where("page_type IN ('DATA_PAGE', 'DATA_PAGE_V2')")
    is_dict = F.col("encoding").isin("PLAIN_DICTIONARY", "RLE_DICTIONARY")
    seen = read.groupBy(*KEY, "row_group").agg(_state(_some(is_dict), _some(~is_dict)).alias("seen"))
    return first.join(seen, [*KEY, "row_group"], "left").withColumn("state", F.coalesce("seen", "state")).drop("seen")


def _state(dictionary: Column, plain: Column) -> Column:
    return F.when(dictionary & plain, "Fallback").when(dictionary, "DictionaryOnly").when(plain, "NoDictionary").otherwise("Unknown")


def dictionary_summary(inputs: Inputs) -> DataFrame:
    """Chunks of each column by dictionary state, estimated ratio of distinct values, and what to do about it."""
    c = F.col
    both = (c("num_values") > 0) & (c("uncompressed") > 0)
    found = dictionary_states(inputs.chunks).groupBy(*KEY).agg(
        *_first("path"), _count(c("state") == "Fallback").alias("fallback"), _count(c("state") == "NoDictionary").alias("no_dictionary"), F.count("*").alias("groups"),
        F.sum(F.when(both, c("num_values"))).alias("values"), F.sum(F.when(both, c("uncompressed"))).alias("bytes"), F.coalesce(F.max(F.when(c("rg_rows") > 0, c("rg_rows"))), F.lit(1)).alias("rows"),
    )
    joined = found.join(inputs.cardinality, KEY)
    limit = dictionary_limit(dictionary_payload(c("distinct_count"), c("values"), c("bytes")))
    action = (
        F.when((c("fallback") > 0) & (c("ratio") > 0.5), "off").when((c("fallback") > 0) & (c("limit") > DICT_PAGE_MOST), "limit_and_rows").when(c("fallback") > 0, "limit")
        .when((c("no_dictionary") > 0) & (c("ratio") < 0.1), "on").otherwise("none")
    )
    return joined.withColumn("limit", limit).withColumn("action", action)


# -- rules ------------------------------------------------------------------------------------------------------------


@rule("low-compression-ratio")
def _low_compression(x: Inputs) -> DataFrame:
    found = compression_ratios(x.chunks).where("ratio > 0.95")
    say = F.format_string("%s compresses to %.1f%% only", F.col("codec"), F.col("ratio") * 100)
    return _finding(found, "low-compression-ratio", "warning", say, F.array(directive("column", F.col("path"), "compression", "uncompressed")))


@rule("missing-page-statistics")
def _missing_pages(x: Inputs) -> DataFrame:
    found = missing_page_statistics(x.chunks).where("missing > 0")
    say = F.format_string("%d of %d chunks have no page statistics", F.col("missing"), F.col("total"))
    return _finding(found, "missing-page-statistics", "warning", say, F.array(directive("column", F.col("path"), "statistics", "page")))


@rule("vector-embedding-page-size")
def _vectors(x: Inputs) -> DataFrame:
    found = vector_widths(x.chunks).where(f"avg_values >= {VECTOR_WIDTH}")
    say = F.format_string("%d values a row: smaller pages let single rows be read", F.col("avg_values"))
    return _finding(found, "vector-embedding-page-size", "warning", say, F.array(directive("file", None, "data_page_size_limit", VECTOR_PAGE_BYTES)))


@rule("dictionary-encoding-cardinality")
def _dictionaries(x: Inputs) -> DataFrame:
    c = F.col
    found = dictionary_summary(x).where("action <> 'none'")
    say = F.when(c("action") == "on", F.format_string("%d of %d chunks have no dictionary at a ratio of %.3f distinct values", c("no_dictionary"), c("groups"), c("ratio")))
    say = say.otherwise(F.format_string("%d of %d chunks fall back from their dictionary at a ratio of %.3f distinct values", c("fallback"), c("groups"), c("ratio")))
    own = lambda name, value: directive("column", c("path"), name, value)
    wanted = (
        F.when(c("action") == "off", F.array(own("dictionary", False))).when(c("action") == "on", F.array(own("dictionary", True))).when(c("action") == "limit", F.array(own("dictionary_page_size_limit", c("limit"))))
        .otherwise(F.array(own("dictionary_page_size_limit", DICT_PAGE_MOST), directive("file", None, "max_row_group_size", dictionary_rows(c("rows"), c("limit")))))
    )
    return _finding(found, "dictionary-encoding-cardinality", F.when(c("action") == "on", "suggestion").otherwise("warning"), say, wanted)


@rule("page-row-group-size")
def _row_groups(x: Inputs) -> DataFrame:
    c = F.col
    found = row_group_policy(x.chunks).where("oversized_rows > 0 OR oversized_bytes > 0")
    by_rows = F.when(c("oversized_rows") > 0, F.format_string("%d of %d row groups have more than %d rows", c("oversized_rows"), c("groups"), F.lit(ROW_GROUP_ROWS)))
    by_size = F.when(c("oversized_bytes") > 0, F.format_string("%d of %d have more than 256 MiB", c("oversized_bytes"), c("groups")))
    # Fixed value: the end of the message, whatever the target.
    say = F.concat(F.concat_ws("; ", by_rows, by_size), F.lit("; max_row_group_size="), c("target_rows").cast("string"), F.lit(" (64K rows), data_page_size_limit=1MB"))
    return _finding(found, "page-row-group-size", "warning", say, F.array(directive("file", None, "max_row_group_size", c("target_rows")), directive("file", None, "data_page_size_limit", DATA_PAGE_BYTES)), of_file=True)


@rule("float-byte-stream-split")
def _floats(x: Inputs) -> DataFrame:
    plain = plain_groups(x.chunks, "BYTE_STREAM_SPLIT", F.col("physical_type").isin("FLOAT", "DOUBLE") & (F.col("max_rep_level") == 0))
    found = plain.where("groups > 0").join(x.cardinality, KEY).where("ratio >= 0.1")
    say = F.format_string("%d chunks of floats are plain", F.col("groups"))
    return _finding(found, "float-byte-stream-split", "suggestion", say, F.array(directive("column", F.col("path"), "encoding", "byte_stream_split")))


@rule("string-byte-array-encoding")
def _strings(x: Inputs) -> DataFrame:
    c = F.col
    few = (c("uncompressed") >= 32 * MIB) & c("groups").between(2, 32) & (c("average") >= 4 * MIB) & c("ratio").between(0.35, 0.75)
    many = (c("uncompressed") >= 64 * MIB) & (c("groups") >= 64) & (c("average") > 0) & (c("average") <= MIB) & c("ratio").between(0.55, 0.85)
    found = string_summary(x.chunks).where(c("plain") & c("dictionary") & ~c("delta") & is_text(c("logical_type"), c("path")) & (few | many))
    say = F.format_string("%d chunks of text fall back to plain", c("groups"))
    own = lambda name, value: directive("column", c("path"), name, value)
    return _finding(found, "string-byte-array-encoding", "suggestion", say, F.array(own("dictionary", False), own("encoding", "delta_length_byte_array")))


@rule("compression-codec-upgrade")
def _codecs(x: Inputs) -> DataFrame:
    c = F.col
    found = codec_votes(x.chunks).where("target IS NOT NULL")
    say = F.format_string("%s suits %d of %d chunks", c("target"), F.when(c("small_chunks"), c("m")).when(c("target") == "lz4_raw", c("lz4")).otherwise(c("zstd")), c("n"))
    return _finding(found, "compression-codec-upgrade", F.when(c("target") == "lz4_raw", "warning").otherwise("suggestion"), say, F.array(directive("column", c("path"), "compression", c("target"))))


@rule("timestamp-delta-encoding")
def _timestamps(x: Inputs) -> DataFrame:
    found = plain_groups(x.chunks, "DELTA_BINARY_PACKED", F.col("physical_type").isin("INT32", "INT64") & F.col("logical_type").isin("TIMESTAMP", "DATE")).where("groups > 0")
    say = F.format_string("%d chunks of times are plain", F.col("groups"))
    return _finding(found, "timestamp-delta-encoding", "suggestion", say, F.array(directive("column", F.col("path"), "encoding", "delta_binary_packed")))


@rule("oversized-string-statistics")
def _statistics(x: Inputs) -> DataFrame:
    found = statistics_peaks(x.chunks).where(f"peak_min > {STATISTICS_BYTES} OR peak_max > {STATISTICS_BYTES}")
    say = F.format_string("bounds of up to %d and %d bytes", F.col("peak_min"), F.coalesce("peak_max", F.lit(0)))
    return _finding(found, "oversized-string-statistics", "warning", say, F.array(directive("file", None, "statistics_truncate_length", STATISTICS_BYTES)))


def evaluate(inputs: Inputs, names: list[str] | None = None) -> DataFrame:
    """Findings of the rules named (all without names), unordered; names that no rule has are passed over."""
    wanted = [f for n, f in RULES.items() if names is None or n in names]
    if not wanted:
        return RULES["missing-page-statistics"](inputs).where(F.lit(False))
    return reduce(DataFrame.unionByName, (f(inputs) for f in wanted))
