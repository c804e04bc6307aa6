"""Rewrite files by a prescription: settings inferred from the input, overridden by directives, written by the planned sink."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.lint import directives, last_wins, lint
from lamina.operators.rules import Inputs
from lamina.plans.dsl import Prescription
from lamina.plans.writer import Plan, infer_all, inferred_columns, plan
from lamina.sources.footer import footers
from lamina.sources.locations import resolve

#: Distinct values over values under which a column's dictionary stays.
SMALL_DICTIONARY = 0.5


def _leaf_names(schema: pa.Schema) -> set[str]:
    import pyarrow.parquet as pq

    sink = pa.BufferOutputStream()
    pq.write_table(schema.empty_table(), sink)
    return {pq.ParquetFile(pa.BufferReader(sink.getvalue())).schema.column(i).path for i in range(len(pq.ParquetFile(pa.BufferReader(sink.getvalue())).schema))}


def write_arrow(df: DataFrame, folder: str, options: dict[str, object]) -> list[str]:
    """Write df as Parquet files in the new folder with pyarrow, a file for each partition; the names of the files.

    Batches are gathered to row groups of row_group_size before they are written, so a task holds one row group. A task that is run again writes a file of another name, so the files are those that
    the result names; others that lie beside them are to be left out."""
    given = dict(options)
    group = int(given.pop("row_group_size", 1_048_576) or 1_048_576)
    key_values, sorting = given.pop("key_values", None), given.pop("sorting", None)
    address = resolve_new(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        writer, held, rows = None, [], 0
        name = f"part-{uuid.uuid4().hex}.parquet"
        store, inner = fs.FileSystem.from_uri(address)
        store.create_dir(inner, recursive=True)

        def out(n: int) -> None:
            nonlocal held, rows
            table = pa.Table.from_batches(held)
            writer.write_table(table.slice(0, n), row_group_size=group)
            rest = table.slice(n)
            held, rows = rest.to_batches() if len(rest) else [], len(rest)

        for batch in batches:
            if writer is None:
                leaves = _leaf_names(batch.schema)
                args = {k: {p: x for p, x in v.items() if p in leaves} if isinstance(v, dict) else [p for p in v if p in leaves] if isinstance(v, list) else v for k, v in given.items()}
                for k in ("compression_level", "column_encoding"):
                    if k in args and not args[k]:
                        del args[k]
                if sorting:
                    args["sorting_columns"] = [pq.SortingColumn(int(i), descending=d == "1", nulls_first=n == "1") for i, d, n in (x.split(":") for x in sorting.split(","))]
                writer = pq.ParquetWriter(f"{inner}/{name}", batch.schema, filesystem=store, **args)
            held.append(batch)
            rows += len(batch)
            while rows >= group:
                out(group)
        if writer is not None:
            if rows:
                out(rows)
            if key_values:
                writer.add_key_value_metadata(key_values)
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return sorted(r.name for r in df.mapInArrow(work, "name string").collect())


def resolve_new(location: str) -> str:
    """An address for a path that needn't exist."""
    return location if "://" in location else "file://" + os.path.abspath(location)


def _apart(source: str, target: str) -> None:
    """An error if one location is the other one or lies in it: a target is replaced."""

    def plain(location: str) -> str:
        at = urlparse(location)
        if at.scheme in ("", "file"):
            return os.path.realpath(unquote(at.path) if at.scheme else location) + "/"
        return location.rstrip("/") + "/"

    a, b = plain(source), plain(target)
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"{source} and {target} lie in each other")


class _Store:
    """The file system of an address, as Spark has it."""

    def __init__(self, spark: SparkSession, address: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(address).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, address: str):
        return self.jvm.org.apache.hadoop.fs.Path(address)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder)))

    def move(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{a} can't be moved to {b}")

    def delete(self, address: str) -> None:
        self.fs.delete(self.path(address), True)


def _weighed(found: DataFrame, columns: DataFrame) -> DataFrame:
    """Directives with why they aren't to be applied, if so: small (the column's dictionary is the better encoding) or large (its dictionary wouldn't be smaller than the values of a row group)."""
    rows = found.where("property = 'max_row_group_size'").groupBy("file").agg(F.max(F.col("value").cast("bigint")).alias("rows"))
    known = columns.select("file", "path", "ratio", "distinct_count").join(rows, "file", "left")
    joined = found.join(known, ["file", "path"], "left")
    why = F.when((F.col("property") == "encoding") & (F.col("ratio") < SMALL_DICTIONARY), "small").when((F.col("property") == "dictionary_page_size_limit") & (F.col("distinct_count") >= F.col("rows")), "large")
    return joined.select(*found.columns, F.coalesce(why, F.lit("")).alias("why"))


def rewrite(spark: SparkSession, source: str, target: str, wanted: Prescription | None = None, unsafe: bool = False, single: bool = False) -> list[tuple[Plan, list[str]]]:
    """Rewrite the file or folder source to the folder target; the plans that were carried out, each with the files it was for, or none if there was nothing to do.

    Each file is written as it was, but for the prescription, without one that of lint for the file; files that are to be written alike are written together. single writes one file for each plan; else each task
    writes its own, and rows keep their order within files. Schema and rows stay as they are. What lies at target is replaced when all is written. A source and a target that are the same or lie in each other are an error.

    Of lint's directives those are left out that would make files larger: encodings in place of a dictionary of few values, and larger dictionaries of columns with more values than a row group will have rows, which lose theirs."""
    _apart(source, target)
    chunks = footers(spark, source).cache()
    try:
        found = None
        if wanted is None:
            inputs = Inputs(chunks)
            found = _weighed(last_wins(directives(lint(spark, inputs=inputs))), inputs.cardinality.join(inferred_columns(chunks).where("dictionary"), ["file", "col_idx"]))
        groups = [(s, Prescription.parse("\n".join(lines)) if wanted is None else wanted, skipped, files) for s, lines, skipped, files in infer_all(chunks, found)]
    finally:
        chunks.unpersist()
    if not any(len(p) for _, p, _, _ in groups):
        return []
    target, staged = resolve_new(target).rstrip("/"), f"{resolve_new(target).rstrip('/')}.new-{uuid.uuid4().hex}"
    store, done = _Store(spark, target), []
    for n, (settings, p, skipped, files) in enumerate(groups):
        planned = plan(p, settings, unsafe, skipped)
        df = spark.read.parquet(*files)
        df = df.coalesce(1) if single else df
        part = f"{staged}/_{n}"
        names = [] if planned.sink == "native" else write_arrow(df, part, planned.options)
        if not names:  # the native sink, or no rows, which Spark has a file for
            df.write.mode("overwrite").options(**(planned.options if planned.sink == "native" else {})).parquet(part)
            names = [x for x in store.names(part) if not x.startswith(("_", "."))]
        for k, name in enumerate(names):
            store.move(f"{part}/{name}", f"{staged}/part-{n:05d}-{k:05d}-{name.removeprefix('part-')}")
        store.delete(part)
        done.append((planned, files))
    store.delete(target)
    store.move(staged, target)
    return done


def same_schema(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two locations have the same schema, nullability apart."""
    plain = lambda p: [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(p).schema]
    return plain(a) == plain(b)
