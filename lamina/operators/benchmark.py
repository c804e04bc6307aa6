"""Measure scan time and size of files before and after a rewrite, and report the changes."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.layout import percent_change
from lamina.operators.rewrite import rewrite, same_schema
from lamina.plans.dsl import Prescription
from lamina.sources.footer import files
from lamina.sources.texts import fetch_if_missing, read_manifest

MEASURES = "idx int, name string, ms double, mb double"


def measure(spark: SparkSession, location: str, iterations: int = 3, batch_size: int = 8192) -> tuple[float, float]:
    """Milliseconds of the best of so many full scans, and MiB on disk. The files are listed before the clock starts; a scan decodes all columns and drops them."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(batch_size))
    df = spark.read.parquet(location)
    times = []
    for _ in range(max(1, iterations)):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times.append((time.perf_counter() - start) * 1000)
    size = files(spark, location).agg(F.sum("size_bytes")).first()[0] or 0
    return min(times), size / (1 << 20)


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(idx, name, sizes, times, costs and their changes) for each index in both, and their totals in a last row without an index; cost is milliseconds plus MiB."""
    joined = before.toDF("idx", "name", "ms0", "mb0").join(after.select("idx", F.col("ms").alias("ms1"), F.col("mb").alias("mb1")), "idx")
    total = joined.agg(F.lit(None).cast("int").alias("idx"), F.lit("total").alias("name"), *(F.sum(c).alias(c) for c in ("ms0", "mb0", "ms1", "mb1")))
    rows = joined.unionByName(total).withColumn("cost0", F.col("ms0") + F.col("mb0")).withColumn("cost1", F.col("ms1") + F.col("mb1"))
    change = [percent_change(F.col(f"{k}0"), F.col(f"{k}1")).alias(f"{k}_change") for k in ("mb", "ms", "cost")]
    return rows.select("idx", "name", "mb0", "mb1", "ms0", "ms1", "cost0", "cost1", *change).orderBy(F.col("idx").asc_nulls_last())


def report_text(rows: DataFrame) -> str:
    """The report as a table."""
    out = [f"{'idx':>5} {'name':<24} {'MiB':>10} {'MiB new':>10} {'%':>8} {'ms':>10} {'ms new':>10} {'%':>8} {'cost %':>8}"]
    for r in rows.collect():
        out.append(f"{'' if r.idx is None else r.idx:>5} {r.name[:24]:<24} {r.mb0:>10.2f} {r.mb1:>10.2f} {r.mb_change:>+8.2f} {r.ms0:>10.2f} {r.ms1:>10.2f} {r.ms_change:>+8.2f} {r.cost_change:>+8.2f}")
    return "\n".join(out)


def benchmark(spark: SparkSession, manifest: str, data_dir: str, output_dir: str, prescriptions: dict[int, Prescription] | None = None, iterations: int = 3, batch_size: int = 8192) -> DataFrame:
    """The report of all locations of a manifest: fetched if missing, rewritten by lint's prescriptions or the given ones (then only those locations), measured before and after."""
    before, after = [], []
    for r in read_manifest(spark, manifest).orderBy("idx").collect():
        if prescriptions is not None and r.idx not in prescriptions:
            continue
        source, target = os.path.join(data_dir, f"{r.idx}.parquet"), os.path.join(output_dir, f"{r.idx}.parquet")
        fetch_if_missing(r.location, source)
        done = rewrite(spark, source, target, None if prescriptions is None else prescriptions[r.idx])
        name = os.path.basename(r.location)
        if done and not same_schema(spark, source, target):
            raise ValueError(f"{name}: the schema changed")
        before.append((r.idx, name, *measure(spark, source, iterations, batch_size)))
        after.append((r.idx, name, *measure(spark, target if done else source, iterations, batch_size)))
    return report(spark.createDataFrame(before, MEASURES), spark.createDataFrame(after, MEASURES))
