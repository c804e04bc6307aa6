"""Lint of files as they arrive: a stream of new files in a folder, whose findings are appended to a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lamina.operators.lint import lint


def lint_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, rules: list[str] | None = None, max_files: int = 1000) -> StreamingQuery:
    """Start a stream that lints each new Parquet file in folder once and appends findings to the Parquet table target; a batch that is run again replaces what it wrote before."""
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", max_files).load(folder).select("path")

    def batch(df: DataFrame, n: int) -> None:
        paths = [r.path for r in df.distinct().collect()]  # at most max_files
        if paths:
            lint(df.sparkSession, *paths, rules=rules).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
