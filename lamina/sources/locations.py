"""Locations: which Parquet files a path names, and byte access to them."""

from __future__ import annotations

import io
import os
from urllib.parse import unquote, urlparse
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession


def resolve(location: str) -> str:
    """A location as an address: addresses stay, relative and absolute local paths become canonical ones."""
    if urlparse(location).scheme and "://" in location:
        return location
    path = location.removeprefix("file:")
    if not os.path.exists(path):
        raise FileNotFoundError(location)
    return "file://" + os.path.realpath(path)


class WebFile(io.RawIOBase):
    """A file of a web server that answers range requests, for random reads."""

    def __init__(self, address: str):
        self.address, self.at = address, 0
        with urlopen(Request(address, headers={"Range": "bytes=0-0"}), timeout=60) as r:
            whole = r.headers.get("Content-Range", "").rpartition("/")[2]
            if r.status != 206 or not whole.isdigit():
                raise OSError(f"{address}: the server doesn't answer range requests")
            self.size = int(whole)

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.size, self.at + n)
        if end <= self.at:
            return b""
        with urlopen(Request(self.address, headers={"Range": f"bytes={self.at}-{end - 1}"}), timeout=60) as r:
            data = r.read()
        self.at += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def is_web(location: str) -> bool:
    return urlparse(location).scheme in ("http", "https")


def data_files(spark: SparkSession, *locations: str) -> list[str]:
    """The Parquet files at locations (files, or folders of them), as Spark's file systems list them, sorted; hidden files and empty folders name none. An address of the web is that of a file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for location in locations:
        if is_web(location):
            found.append(location)
            continue
        path = jvm.org.apache.hadoop.fs.Path(resolve(location))
        store = path.getFileSystem(conf)
        if store.getFileStatus(path).isFile():
            found.append(path.toString())
            continue
        below = store.listFiles(path, True)
        while below.hasNext():
            name = below.next().getPath().toString()
            inner = name.removeprefix(store.makeQualified(path).toString())
            if not any(part.startswith(("_", ".")) for part in inner.split("/")):
                found.append(name)
    return sorted(found)


def open_file(address: str):
    """A file for random reads, wherever it is: local ones as such, others by the file system that their address names."""
    at = urlparse(address)
    if at.scheme in ("", "file"):
        return open(unquote(at.path), "rb")
    if is_web(address):
        return WebFile(address)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(address)
    return store.open_input_file(inner)


def size_of(f) -> int:
    """Bytes of an open file."""
    here = f.tell()
    f.seek(0, 2)
    n = f.tell()
    f.seek(here)
    return n
