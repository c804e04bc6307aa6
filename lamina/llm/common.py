"""Helpers shared by the corpus operators: shared-folder tables, word splitting and vectorised hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session has it.

    Only where a local session names none, as in tests, is a temporary folder made and set; on a cluster that is an error, as executors couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not found:
        found = spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lamina-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/lamina/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to a new table in the shared folder and read again: lineage is cut and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, in whichever store it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_of(df: DataFrame) -> str:
    """The folder of a table that stored() wrote."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


# ---------------------------------------------------------------------------------------------------------------------
# Memory of Python workers
# ---------------------------------------------------------------------------------------------------------------------


def lean(work, mapped: int = 1 << 20):
    """work for mapInArrow, with what a task has freed given back to the machine: workers live on, and what they keep counts against those that run beside them.

    Arrays of so many mapped bytes and more are given back when they are freed; what is smaller now and then. That takes some time of arrays that come and go, so work that is near its time and not its memory may say more."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = None
        if sys.platform == "linux":
            try:
                libc = ctypes.CDLL("libc.so.6")
                libc.mallopt(-3, mapped)
                pa.set_memory_pool(pa.system_memory_pool())
            except (OSError, AttributeError):
                libc = None  # another C library: nothing to tell it
        try:
            for n, batch in enumerate(work(batches)):
                yield batch
                if libc and n % 8 == 7:
                    libc.malloc_trim(0)
        finally:
            gc.collect()
            if libc:
                libc.malloc_trim(0)

    return run


# ---------------------------------------------------------------------------------------------------------------------
# Vectorised word hashing
# ---------------------------------------------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _P)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        with np.errstate(over="ignore"):
            _powers[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _P))])
            _powers[1] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _INVERSE))])
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array: runs of bytes that are no ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of the byte spans, which lie in order and don't overlap. Equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            # A block of spans whose bytes are hashed from one running sum; a longer span makes a longer block.
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, base + block, side="right")))
            power, inverse = _power_tables(int(ends[to - 1]) - base)
            part = data[base : int(ends[to - 1])]
            total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * power[: len(part)])])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _M2)
            at = to
    return out


def text_bytes(value) -> bytes:
    """UTF-8 bytes of a text with A-Z lowered; a null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass").lower() if isinstance(value, str) else bytes(value).lower()
