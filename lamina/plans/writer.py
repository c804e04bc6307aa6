"""How files are written: settings inferred from a file, overridden by a prescription, and planned for a sink that can apply them.

The native sink is Spark's own Parquet writer; it knows one codec a file and no encodings of columns. The Arrow sink writes with pyarrow in tasks; it
knows codecs, encodings and levels of columns, and no bloom filters. What neither applies, or what Spark couldn't read back, is listed as unapplied.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from lamina.plans.dsl import Codec, Directive, Prescription

LEVEL_ENCODINGS = ("RLE", "BIT_PACKED")
DICTIONARY_ENCODINGS = ("PLAIN_DICTIONARY", "RLE_DICTIONARY")

#: Levels that footers don't tell: those that writers take for a codec by default.
DEFAULT_LEVELS = {"ZSTD": 1, "GZIP": 6, "BROTLI": 1}


def mode(chunks: DataFrame, value: str, key: list[str], order: list[str], name: str) -> DataFrame:
    """The most frequent value for each key; of equally frequent ones the one that first occurs last."""
    first = F.min(F.struct(*order)).alias("first")
    return chunks.groupBy(*key, value).agg(F.count("*").alias("n"), first).groupBy(*key).agg(F.max_by(value, F.struct("n", "first")).alias(name))


def writer_version(version: Column) -> Column:
    """v1 or v2 of footer versions 1 and 2, else null."""
    return F.when(version == 1, "v1").when(version == 2, "v2")


def inferred_columns(chunks: DataFrame) -> DataFrame:
    """(file, col_idx, path, codec, encoding, dictionary, statistics, bloom_filter) as each column of a file was written."""
    key = ["file", "col_idx"]
    listed = chunks.select(*key, "row_group", F.posexplode("encodings").alias("i", "encoding")).where(~F.col("encoding").isin(*LEVEL_ENCODINGS, *DICTIONARY_ENCODINGS))
    codec, encoding = mode(chunks, "codec", key, ["row_group"], "codec"), mode(listed, "encoding", key, ["row_group", "i"], "encoding")
    uses = F.col("dict_offset").isNotNull() | F.arrays_overlap("encodings", F.array(*map(F.lit, DICTIONARY_ENCODINGS)))
    rest = chunks.groupBy(*key).agg(
        F.min_by("path", "row_group").alias("path"), F.bool_or(uses).alias("dictionary"), F.bool_or(F.col("bloom_offset").isNotNull()).alias("bloom_filter"),
        F.when(F.bool_or(F.col("column_index_offset").isNotNull()), "page").when(F.bool_or("has_stats"), "chunk").otherwise("none").alias("statistics"),
    )
    return rest.join(codec, key, "left").join(encoding, key, "left").select(*key, "path", "codec", "encoding", "dictionary", "statistics", "bloom_filter")


def inferred_files(chunks: DataFrame) -> DataFrame:
    """(file, version, created_by, key_values, sorting, max_row_group_size) as each file was written; sorting columns only where all row groups have the same."""
    same = F.when((F.count_distinct("sorting") == 1) & ~F.bool_or(F.col("sorting").isNull()), F.first("sorting"))
    rows = F.max("rg_rows")
    return chunks.groupBy("file").agg(
        writer_version(F.max("writer_version")).alias("version"), F.max("created_by").alias("created_by"), F.first("key_values").alias("key_values"), same.alias("sorting"), F.when(rows > 0, rows).alias("max_row_group_size")
    )


#: Why directives of lint aren't applied.
WHY = {"small": "the column's dictionary of few values is smaller", "large": "a row group has fewer rows than the dictionary would have values"}
#: Rows of a row group that writers make by themselves.
USUAL_ROWS = 1_048_576

# Names of gzip levels 0 to 9.
GZIP_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


@dataclass
class ColumnSettings:
    """How a column is to be written."""

    codec: Codec | None = None
    encoding: str | None = None
    dictionary: bool | None = None
    dictionary_page_size_limit: int | None = None
    statistics: str | None = None
    bloom_filter: bool | None = None
    bloom_filter_ndv: int | None = None
    bloom_filter_fpp: float | None = None


@dataclass
class Settings:
    """How a file is to be written."""

    codec: Codec | None = None
    max_row_group_size: int | None = None
    data_page_size_limit: int | None = None
    statistics_truncate_length: int | None = None
    truncate: bool = False
    version: str | None = None
    created_by: str | None = None
    key_values: dict[str, str] = field(default_factory=dict)
    sorting: str | None = None
    columns: dict[str, ColumnSettings] = field(default_factory=dict)

    def apply(self, prescription: Prescription) -> Settings:
        """Itself with the directives, in order; columns hold over the file whatever the order."""
        for d in prescription:
            name = "codec" if d.property == "compression" else d.property
            if d.path is not None:
                setattr(self.columns.setdefault(d.path, ColumnSettings()), name, d.value)
            else:
                setattr(self, name, d.value)
                self.truncate |= name == "statistics_truncate_length"
        return self


def codec_of(name: str) -> Codec:
    """The codec of a footer, at its default level."""
    return Codec(name.lower(), DEFAULT_LEVELS.get(name)) if name != "LZ4" else Codec("lz4_raw")


def infer(chunks: DataFrame) -> Settings:
    """The settings of one file from its chunks."""
    f = inferred_files(chunks).first()
    if f is None:
        return Settings()
    out = Settings(max_row_group_size=f.max_row_group_size, version=f.version, created_by=f.created_by, key_values=dict(f.key_values or {}), sorting=f.sorting)
    for r in inferred_columns(chunks).orderBy("col_idx").collect():
        out.columns[r.path] = ColumnSettings(codec=codec_of(r.codec), encoding=(r.encoding or "").lower() or None, dictionary=r.dictionary, statistics=r.statistics, bloom_filter=r.bloom_filter)
    return out


def infer_all(chunks: DataFrame, found: DataFrame | None = None) -> list[tuple[Settings, list[str], dict[str, str], list[str]]]:
    """The settings of files, with their directives as text and why some aren't to be applied, by found (file, ordinal, scope, path, property, value, why): a tuple, with the names of its files, for all files that have the same.

    The driver gets the distinct settings and the names of files. The largest row group isn't a setting of files that have one of a usual size."""
    column = F.struct("col_idx", "path", "codec", "encoding", "dictionary", "statistics", "bloom_filter")
    columns = inferred_columns(chunks).groupBy("file").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    several = chunks.groupBy("file").agg((F.max("row_group") > 0).alias("several"))
    rows = F.when(F.col("several") | (F.col("max_row_group_size") > USUAL_ROWS), F.col("max_row_group_size")).alias("rows")
    one = inferred_files(chunks).join(several, "file").join(columns, "file").select("file", "version", "created_by", F.array_sort(F.map_entries("key_values")).alias("key_values"), "sorting", rows, "columns")
    if found is None:
        one = one.withColumn("lines", F.array().cast("array<struct<line:string,why:string>>"))
    else:
        line = F.struct("ordinal", F.concat_ws(" ", F.lit("set"), "scope", "path", "property", "value").alias("line"), "why")
        lines = found.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["line"].alias("line"), x["why"].alias("why"))).alias("lines"))
        one = one.join(lines, "file", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<struct<line:string,why:string>>")))
    keys = [c for c in one.columns if c != "file"]
    out = []
    for r in one.groupBy(*keys).agg(F.array_sort(F.collect_list("file")).alias("files")).collect():
        s = Settings(max_row_group_size=r.rows, version=r.version, created_by=r.created_by, key_values={k: v for k, v in r.key_values or ()}, sorting=r.sorting)
        for c in r.columns:
            s.columns[c.path] = ColumnSettings(codec=codec_of(c.codec), encoding=(c.encoding or "").lower() or None, dictionary=c.dictionary, statistics=c.statistics, bloom_filter=c.bloom_filter)
        out.append((s, [x.line for x in r.lines], {x.line: x.why for x in r.lines if x.why}, list(r.files)))
    return sorted(out, key=lambda x: x[3])


@dataclass
class Plan:
    """The sink that is to write, its options, directives that it doesn't apply, with the reason, and what it loses of how the file was written."""

    sink: str
    options: dict[str, object] = field(default_factory=dict)
    unapplied: list[tuple[Directive, str]] = field(default_factory=list)
    lost: list[str] = field(default_factory=list)


NATIVE_COLUMN = ("dictionary", "dictionary_page_size_limit", "statistics", "bloom_filter", "bloom_filter_ndv", "bloom_filter_fpp")


def _native_codec(codec: Codec, options: dict) -> None:
    options["compression"] = codec.name
    if codec.name == "zstd":
        options["parquet.compression.codec.zstd.level"] = str(codec.level)
    elif codec.name == "gzip":
        options["zlib.compress.level"] = GZIP_LEVELS[codec.level]


def native_options(prescription: Prescription) -> tuple[dict[str, object], list[tuple[Directive, str]]]:
    """Options of Spark's Parquet writer for a prescription, and what they can't say."""
    options: dict[str, object] = {}
    left: list[tuple[Directive, str]] = []
    limits = []
    for (path, name), d in prescription.settled().items():
        if name == "compression" and path is None and d.value.name != "brotli":
            _native_codec(d.value, options)
        elif name == "max_row_group_size":
            options["parquet.block.row.count.limit"] = d.shown
        elif name == "data_page_size_limit":
            options["parquet.page.size"] = d.shown
        elif name == "statistics_truncate_length":
            n = "2147483647" if d.value is None else d.shown
            options |= {"parquet.statistics.truncate.length": n, "parquet.columnindex.truncate.length": n}
        elif name == "dictionary":
            options[f"parquet.enable.dictionary#{path}"] = d.shown
        elif name == "dictionary_page_size_limit":
            limits.append(d.value)
        elif name == "statistics":
            options[f"parquet.column.statistics.enabled#{path}"] = str(d.value != "none").lower()
            if d.value == "chunk":
                left.append((d, "Spark's writer has page statistics wherever it has chunk statistics"))
        elif name == "bloom_filter":
            options[f"parquet.bloom.filter.enabled#{path}"] = d.shown
        elif name == "bloom_filter_ndv":
            options[f"parquet.bloom.filter.expected.ndv#{path}"] = d.shown
        elif name == "bloom_filter_fpp":
            options[f"parquet.bloom.filter.fpp#{path}"] = d.shown
        else:
            left.append((d, "no codec of that name" if name == "compression" and path is None else "Spark's writer has no setting of it for a column"))
    if limits:
        options["parquet.dictionary.page.size"] = str(max(limits))
    return options, left


def apply_prescription(writer: DataFrameWriter, text: str) -> DataFrameWriter:
    """A DataFrame writer with a prescription's settings; a text that can't be read or contradicts itself is an error."""
    options, _ = native_options(Prescription.parse(text).validate())
    return writer.options(**options)


def _kept_by_native(settings: Settings, kept: list[Directive]) -> list[Directive]:
    """What a file was written with, but for what directives say, as directives that Spark's writer applies."""
    said = {(d.path, d.property) for d in kept}
    base = next(iter(settings.columns.values())).codec
    out = [Directive("compression", base)] if base and base.name != "brotli" else []
    if settings.max_row_group_size and (None, "max_row_group_size") not in said:
        out.append(Directive("max_row_group_size", settings.max_row_group_size))
    for path, c in settings.columns.items():
        if c.dictionary is False and (path, "dictionary") not in said:
            out.append(Directive("dictionary", False, path))
        if c.statistics == "none" and (path, "statistics") not in said:
            out.append(Directive("statistics", "none", path))
        if c.bloom_filter and (path, "bloom_filter") not in said:
            out.append(Directive("bloom_filter", True, path))
    return out


def _lost(settings: Settings, sink: str) -> list[str]:
    """What a sink can't write as it was."""
    out = [f"created_by {settings.created_by}"] if settings.created_by else []
    if sink == "native":
        out += [f"version {settings.version}"] if settings.version == "v2" else []
        out += [f"sorting {settings.sorting}"] if settings.sorting else []
        out += [f"key {k}" for k in sorted(settings.key_values) if not k.startswith("org.apache.spark.")]
        out += [f"encoding {c.encoding} of {p}" for p, c in settings.columns.items() if c.encoding not in (None, "plain")]
    else:
        out += [f"bloom_filter of {p}" for p, c in settings.columns.items() if c.bloom_filter]
    return out


def plan(prescription: Prescription, settings: Settings | None = None, unsafe: bool = False, skipped: dict[str, str] | None = None) -> Plan:
    """Choose the sink for a prescription: the native one if it can apply all of it. With unsafe also layouts are written that Spark's vectorized reader can't read. Directives whose text is in skipped aren't applied;
    a column whose dictionary is too large (see rewrite) has none."""
    kept, left = [], []
    for d in prescription.settled().values():
        if why := (skipped or {}).get(str(d)):
            left.append((d, WHY[why]))
            if why == "large":
                kept.append(Directive("dictionary", False, d.path))
        elif d.property == "encoding" and d.value == "byte_stream_split" and not unsafe:
            left.append((d, "Spark's vectorized reader can't read BYTE_STREAM_SPLIT"))
        elif d.property == "compression" and d.value.name == "brotli" and not unsafe:
            left.append((d, "Spark has no brotli codec"))
        else:
            kept.append(d)
    by_column = [d for d in kept if d.path is not None and d.property not in NATIVE_COLUMN]
    base_mixed = settings is not None and len({str(c.codec) for c in settings.columns.values()}) > 1
    if not by_column and not base_mixed and not any(d.property == "compression" and d.value.name == "brotli" for d in kept):
        if settings is not None and settings.columns:  # columns have the codec that they had, which a file's directive doesn't change
            kept = [*(d for d in kept if not (d.path is None and d.property == "compression")), *_kept_by_native(settings, kept)]
        options, more = native_options(Prescription(kept))
        return Plan("native", options, left + more, _lost(settings, "native") if settings is not None else [])
    lost = _lost(settings, "arrow") if settings is not None else []
    final = (settings or Settings()).apply(Prescription(kept))
    left += [(d, "pyarrow's writer has no bloom filters") for d in kept if d.property.startswith("bloom")]
    left += [(d, "pyarrow's writer doesn't cut statistics") for d in kept if d.property == "statistics_truncate_length"]
    return Plan("arrow", arrow_options(final), left, lost)


def arrow_options(s: Settings) -> dict[str, object]:
    """Arguments of pyarrow's ParquetWriter for settings, and row_group_size."""
    columns = s.columns
    name = lambda c: {"lz4_raw": "LZ4", "uncompressed": "NONE"}.get(c.name, c.name.upper())
    default = s.codec or Codec("snappy")
    codecs = {p: c.codec or default for p, c in columns.items()}
    encodings = {p: c.encoding.upper() for p, c in columns.items() if c.encoding and c.encoding != "plain"}
    # An encoding is that of values outside a dictionary: the column's dictionary is off where one is set.
    use = [p for p, c in columns.items() if c.dictionary is not False and p not in encodings]
    stats = [p for p, c in columns.items() if c.statistics != "none"]
    limits = [c.dictionary_page_size_limit for c in columns.values() if c.dictionary_page_size_limit]
    out: dict[str, object] = {
        "compression": {p: name(c) for p, c in codecs.items()} or name(default), "compression_level": {p: c.level for p, c in codecs.items() if c.level is not None} or None, "use_dictionary": use if columns else True,
        "column_encoding": encodings or None, "write_statistics": stats if columns else True, "write_page_index": any(c.statistics == "page" for c in columns.values()), "row_group_size": s.max_row_group_size,
        "data_page_size": s.data_page_size_limit, "dictionary_pagesize_limit": max(limits) if limits else None, "version": "1.0" if s.version == "v1" else "2.6",
    }
    # The schema that pyarrow keeps for itself is written anew.
    out |= {"key_values": {k: v for k, v in s.key_values.items() if k != "ARROW:schema"} or None, "sorting": s.sorting}
    return {k: v for k, v in out.items() if v is not None}
