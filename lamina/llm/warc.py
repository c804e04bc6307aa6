"""WARC archives: records and their index are written first, then selected records are read in coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lean, stored

#: Rows that a broadcast may have; a larger side is shuffled. Bytes between two records that are read over, and bytes of a range at most (a longer record is a range of its own).
MAX_BROADCAST, MAX_GAP, MAX_RANGE = 1_000_000, 64 << 10, 4 << 20
#: Bytes of archives that a task reads at least, and tasks at most.
TASK_BYTES, MAX_TASKS = 4 << 20, 20_000
#: The field of an address as it was given, percent-encoded.
SOURCE = "WARC-X-Source-URI"
#: Payloads from so many bytes on are stored once.
MIN_DEDUP_BYTES = 0

_INDEX = "file string, offset long, length long, url string, digest string, page_id long, type string"
_READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, intact boolean"


def _open(path: str, mode: str):
    """A file of the shared folder: opened as such if the folder is mounted, else by the file system that its address names."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(at.path), exist_ok=True)
        return open(at.path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if "w" in mode:
        store.create_dir(os.path.dirname(inner), recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a WARC record; a revisit has the head of the response alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_named(page_id)}>"]
    if url is not None:
        target = quote(url, safe=":/?#[]@!$&()*+,;=%~")
        # An address that the header can't have as it is has a second field.
        lines += [f"WARC-Target-URI: {target}", *([f"{SOURCE}: {quote(url, safe='')}"] if target != url else [])]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_named(refers_to)}>"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _named(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def _id(text: str) -> int | None:
    return int(text) if text else None


def parse(member: bytes) -> tuple:
    """The values of _READ of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = _id(fields["WARC-Refers-To"][10:-1]) if revisit else None
    intact = revisit or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    url = unquote(fields[SOURCE]) if SOURCE in fields else fields.get("WARC-Target-URI")
    return _id(fields["WARC-Record-ID"][10:-1]), url, fields["WARC-Type"], refers, digest, size, None if revisit else payload, intact


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Write a record for each row to archives in folder (one to be shared by all executors) and return the index, a written table: file, offset, length, url, digest, page_id, type.

    Of rows with equal payloads of min_bytes bytes or more the one with the largest id is a response and the others are revisits of it; rows that repeat that id are
    responses too, and where all ids are null all are responses. A null payload is empty, a null id counts as the smallest. Each task writes a file of its own
    name, which the index has only if the task ended, so a lost executor leaves at most a file that nothing refers to. Payloads aren't shuffled while at most MAX_BROADCAST of them are repeated."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    equal = stored(rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n"), "equal")
    joined = rows.join(F.broadcast(equal) if equal.count() <= MAX_BROADCAST else equal, ["sha", "size"], "left")
    revisit = F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        names = ["file", "offset", "length", "url", "digest", "page_id", "type"]
        try:
            for batch in batches:
                index: list[tuple] = []
                for page, url, payload, sha, size, best, again in zip(*(batch.column(i) for i in range(7))):
                    page, url, again = page.as_py(), url.as_py(), again.as_py()
                    digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    data = record(page, url, payload.as_py() or b"", digest, size.as_py(), best.as_py(), again)
                    out = out or _open(path, "wb")
                    out.write(data)
                    index.append((path, at, len(data), url, digest, page, "revisit" if again else "response"))
                    at += len(data)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names)
        finally:
            if out:
                out.close()

    payload = F.when(~revisit, F.col("payload"))
    return stored(joined.select("id", "url", payload.alias("payload"), "sha", "size", "best", revisit.alias("again")).mapInArrow(lean(work), _INDEX), "warc-index")


def ranges(places: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Byte ranges that hold the records at sorted (offset, length), each with its records: near ones are read together."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in places:
        if out and offset - out[-1][1] <= MAX_GAP and offset + length - out[-1][0] <= MAX_RANGE:
            out[-1][2].append((offset, length))
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2])
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read_warc(index: DataFrame) -> DataFrame:
    """The records that index rows (file, offset, length) select, read in order of files and offsets, near ones in one range. A task has stretches of files of TASK_BYTES in all, or more where that would be over MAX_TASKS tasks.

    Returns page_id, url (as it was given), record_type, refers_to, payload_digest, payload_bytes (both of the full payload), payload (null of a revisit) and intact (whether a response's payload has its digest
    and length). An empty index gives an empty result; a record selected twice is returned twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_())
        names = [x.split(" ")[0] for x in _READ.split(", ")]
        for batch in batches:
            files: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                files.setdefault(file, []).append((offset, length))
            for file, places in files.items():
                with _open(file, "rb") as f:
                    for start, end, records in ranges(places):
                        f.seek(start)
                        data = f.read(end - start)
                        found = [parse(data[o - start : o - start + n]) for o, n in records]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(MAX_TASKS, -(-total // TASK_BYTES)))
    stretch = F.floor(F.col("offset") / max(TASK_BYTES, total // MAX_TASKS))
    return index.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset").mapInArrow(lean(work), _READ)
