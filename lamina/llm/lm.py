"""An interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped into memory by the workers that score.

Words are known by 64-bit hashes, cut by their first bits into buckets; a bucket is a file, named by its number, with its sorted hashes and their counts. A word's id is its bucket
and its place there. A bigram is the pair of two ids put through a bijection, so that these hashes spread evenly and never collide. Each task sums what
it reads before it goes out, packed by bucket, so a frequent word or bigram counts once for each task or so. Only totals come to the driver.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import crc_mod, lean, mix64, shared_path, span_hashes, stored, text_bytes, word_spans
from lamina.llm.warc import _open

#: Rows whose crc32 of the id modulo FOLDS is 0 are held out; the constant added to base counts.
FOLDS, BASE_ADD = 10, 0.1
#: Bytes of text worked on at a time, sums a task keeps before rows go out, text bytes for each bucket.
_CHUNK, _KEPT, _BUCKET_BYTES = 2 << 20, 1_000_000, 6 << 20
#: Sums of a bucket that go out in a row, and that a task keeps at least; partitions that buckets are dealt to at most; bits of a word's id.
_ROW, _LEAST, _PARTITIONS, _ID_BITS = 4096, 1 << 16, 50_000, 32
#: Bytes of arrays that are given back at once.
_FREED = 16 << 20
#: Bytes and number of bucket files that a worker has mapped at most.
_MAPPED, _MAPS = 384 << 20, 8192
_PACKED = "bucket long, sums binary"

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_M1_INV, _M2_INV = (np.uint64(pow(m, -1, 1 << 64)) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    s = lambda x, k: x ^ (x >> np.uint64(k)) ^ (x >> np.uint64(2 * k)) ^ (x >> np.uint64(min(63, 3 * k)) if 3 * k < 64 else np.uint64(0))
    x = s(x, 31) * _M2_INV
    x = s(x, 27) * _M1_INV
    return s(x, 30)


def token_chunks(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the tokens of texts in chunks, an END after each text's words; and where each text begins."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at + len(parts) < len(texts) and (size < _CHUNK or not parts):
            parts.append(text_bytes(texts[at + len(parts)]))
            size += len(parts[-1]) + 1
        data = np.frombuffer(b" ".join(parts), np.uint8)
        starts, ends = word_spans(data)
        h = span_hashes(data, starts, ends)
        cuts = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
        yield np.insert(h, cuts, END), np.concatenate([[0], cuts[:-1]]) + np.arange(len(parts))
        at += len(parts)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values (one column or several)."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


class _Sums:
    """Sums by key that go out when they are many, packed: a row has the keys of one bucket (by their first bits) and their sums."""

    def __init__(self, bits: int, width: int):
        self.bits, self.width, self.parts, self.size, self.floor = bits, width, [], 0, 0
        # Rows are in proportion to what is read, as more are kept where there are more buckets; the more numbers with a key, the fewer keys.
        self.most = max(1, min(max(_ROW << bits, _LEAST), 2 * _KEPT) // (1 + width))

    def add(self, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(_summed(keys, values))
        self.size += len(self.parts[-1][0])
        if self.size > self.most + self.floor:
            self.merge()
            if self.size > self.most // 2:
                yield from self.out()

    def merge(self) -> None:
        if self.parts:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.size = self.floor = len(self.parts[0][0])

    def out(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        if self.size:
            keys, values = self.parts[0]
            values = values.reshape(len(keys), self.width)
            bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)]
            packed = [keys[i:j].tobytes() + values[i:j].T.tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(packed, pa.binary())], ["bucket", "sums"])
        self.parts, self.size, self.floor = [], 0, 0


def _save(path: str, *arrays: np.ndarray) -> None:
    """Write arrays one after another, all or nothing: a task that is run again, or twice at a time, leaves the same file."""
    at = urlparse(path)
    local = at.scheme in ("", "file")
    hidden = f"{path}.{uuid.uuid4().hex}" if local else path  # a store has a whole object or none
    with _open(hidden, "wb") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    if local:
        os.replace(urlparse(hidden).path, at.path)


_maps: OrderedDict[str, np.ndarray] = OrderedDict()
_mapped_bytes = 0


def _mapped(path: str) -> np.ndarray:
    """The bytes of a file of the shared folder, mapped into memory, none if there is no such file; from a store that isn't mounted by way of a file that goes with the mapping. Those used last are kept, _MAPPED bytes in all."""
    global _mapped_bytes
    if path in _maps:
        _maps.move_to_end(path)
        return _maps[path]
    at = urlparse(path)
    none = np.zeros(0, np.uint8)
    if at.scheme in ("", "file"):
        found = np.memmap(at.path, np.uint8, "r") if os.path.exists(at.path) and os.path.getsize(at.path) else none
    else:
        try:
            with tempfile.NamedTemporaryFile() as f, _open(path, "rb") as source:
                while data := source.read(8 << 20):
                    f.write(data)
                f.flush()
                found = np.memmap(f.name, np.uint8, "r") if f.tell() else none
        except FileNotFoundError:
            found = none
    _maps[path] = found
    _mapped_bytes += len(found)
    while len(_maps) > 1 and (_mapped_bytes > _MAPPED or len(_maps) > _MAPS):
        _mapped_bytes -= len(_maps.popitem(last=False)[1])
    return found


def _small(values: np.ndarray) -> np.ndarray:
    """Numbers in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _columns(path: str, width: int) -> list[np.ndarray]:
    """The keys and columns of a bucket file: after the number of keys and the bytes of a number of each column."""
    data = _mapped(path)
    if not len(data):
        return [np.zeros(0, np.uint64), *(np.zeros(0, np.uint8) for _ in range(width))]
    n, *sizes = data[: 8 * (1 + width)].view(np.int64).tolist()
    at, out = 8 * (1 + width), []
    for size in (8, *sizes):
        out.append(data[at : at + n * size].view(f"u{size}"))
        at += n * size
    return out


def _buckets(folder: str, width: int):
    """A function for mapInArrow: of packed rows sorted by bucket, with all rows of a bucket in a task, write a file for each bucket: its keys, sorted, and the columns of sums. Rows out: numbers of keys, and of first sums over 0 and of 1 to 4, the largest number, sums of the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        now, held = None, 0
        total = np.zeros(7, np.int64)
        most = 0

        def close() -> None:
            nonlocal most, held
            if parts:
                keys, sums = _summed(*(np.concatenate(x) for x in zip(*parts)))
                columns = [_small(c) for c in sums.T]
                _save(f"{folder}/{now}.bin", np.array([len(keys), *(c.itemsize for c in columns)], np.int64), keys, *columns)
                first = sums[:, 0]
                total[:] += [len(keys), (first > 0).sum(), *((first == k).sum() for k in (1, 2, 3, 4)), first.sum()]
                most = max(most, len(keys))
            parts.clear()
            held = 0

        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    close()
                    now = bucket
                data = packed.as_buffer()
                n = len(data) // (8 * (1 + width))
                keys = np.frombuffer(data, np.uint64, n)
                parts.append((keys, np.frombuffer(data, np.int64, n * width, 8 * n).reshape(width, n).T))
                held += n
                if held > _KEPT and len(parts) > 8:
                    parts[:] = [_summed(*(np.concatenate(x) for x in zip(*parts)))]
                    held = 0
        close()
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*total, most)], [x.split(" ")[0] for x in _SUMMARY.split(", ")])

    return work


_SUMMARY = "n long, positive long, one long, two long, three long, four long, sum long, most long"


def _by_bucket(df: DataFrame, bits: int, folder: str, width: int, label: str) -> Row:
    """Write the buckets of packed rows; what _buckets says of them, summed."""
    partitions = min(1 << bits, _PARTITIONS)
    dealt = df.repartitionById(partitions, F.pmod("bucket", F.lit(partitions)).cast("int")).sortWithinPartitions("bucket")
    done = stored(dealt.mapInArrow(lean(_buckets(folder, width), _FREED), _SUMMARY), label)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in done.columns[:-1]]
    return done.agg(*sums, F.coalesce(F.max("most"), F.lit(0)).alias("most")).first()


def _of_buckets(spark: SparkSession, bits: int, work, schema: str) -> DataFrame:
    """What work says of the numbers of all buckets."""
    numbers = spark.range(0, 1 << bits, 1, max(1, min(_PARTITIONS, (1 << bits) // 4)))
    return numbers.mapInArrow(lean(work, _FREED), schema)


@dataclass
class Table:
    """Sorted hash arrays in bucket files, which are named by their number; a key's number is that of its bucket and its place there."""

    bits: int
    width: int
    folder: str

    def path(self, bucket: int) -> str:
        return f"{self.folder}/{bucket}.bin"

    def find(self, keys: np.ndarray, columns: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of sorted keys the numbers (-1 where absent) and values of the columns (0 where absent)."""
        place, out = np.full(len(keys), -1, np.int64), [np.zeros(len(keys), np.int64) for _ in columns]
        if not len(keys):
            return place, out
        bucket = keys >> np.uint64(64 - self.bits)
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            b = int(bucket[lo])
            hashes, *values = _columns(self.path(b), self.width)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(hashes, keys[lo:hi]), len(hashes) - 1)
            there = hashes[at] == keys[lo:hi]
            place[lo:hi] = np.where(there, at + (b << (_ID_BITS - self.bits)), -1)
            for o, c in zip(out, columns):
                o[lo:hi] = np.where(there, values[c][at], 0)
        return place, out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of counts 1 to 4, within what they can be; 0.75 where they can't be told."""
    if not n[0] or not n[1]:
        return 0.75, 0.75, 0.75
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.75 for k in range(3)]
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))


@dataclass
class KneserNey:
    """The model: words (count), their statistics by id (total and numbers of bigrams 1, 2, 3+ as a context, distinct words before), and bigrams."""

    words: Table
    bigrams: Table
    stats: Table
    tokens: int
    distinct: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    continuations: int
    word_mass: float

    def _discount(self, c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(c, 3)]

    def score(self, texts: list) -> Iterator[tuple[np.ndarray, ...]]:
        """For chunks of texts: tokens, known tokens, base score and log10 probability of each text."""
        for h, begins in token_chunks(texts):
            distinct, inverse = np.unique(np.concatenate([h, [START]]), return_inverse=True)
            ids, (count,) = self.words.find(distinct, (0,))
            stat_keys = mix64(ids.astype(np.uint64))
            order = np.argsort(stat_keys)
            _, found = self.stats.find(stat_keys[order], (0, 1, 2, 3, 4))
            total, one, two, more, before = (np.empty_like(x) for x in found)
            for to, x in zip((total, one, two, more, before), found):
                to[order] = np.where(ids[order] >= 0, x, 0)
            word = inverse[:-1]
            context = np.concatenate([inverse[-1:], word[:-1]])
            context[begins] = inverse[-1]
            c = count[word]
            base = np.log10((c + BASE_ADD) / (self.tokens + BASE_ADD * (self.distinct + 1)))
            lower = np.maximum(before - self._discount(before, self.word_discounts), 0) / max(1, self.continuations) + self.word_mass / (self.distinct + 1)
            d1, d2, d3 = self.bigram_discounts
            mass = np.where(total > 0, (d1 * one + d2 * two + d3 * more) / np.maximum(total, 1), 1.0)
            pair = mix64(ids[context].astype(np.uint64) << np.uint64(32) | ids[word].astype(np.uint64) & np.uint64(0xFFFFFFFF))
            keys, at = np.unique(pair, return_inverse=True)
            _, (seen,) = self.bigrams.find(keys, (0,))
            seen = np.where((ids[context] >= 0) & (ids[word] >= 0), seen[at], 0)
            p = np.maximum(seen - self._discount(seen, self.bigram_discounts), 0) / np.maximum(total[context], 1) + mass[context] * lower[word]
            sums = lambda x: np.add.reduceat(x, begins)
            yield sums(np.ones(len(h), np.int64)), sums((c > 0).astype(np.int64)), sums(base), sums(np.log10(p))


def fit_kneser_ney(df: DataFrame, text_col: str = "text") -> KneserNey:
    """Count the model of all rows of df. A null or empty text is an end alone; an empty df gives a model by which every token is unknown.

    Bucket files are named by number and summed up in Spark, so what the driver holds doesn't grow. More words than ids can tell, of which there are four billion, are an error."""
    spark = df.sparkSession
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(size // _BUCKET_BYTES).bit_length())
    few = max(3, bits - 3)  # words are fewer than what is counted of them
    folder = shared_path(spark, "lm")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(few, 1)
        for batch in batches:
            for h, _ in token_chunks(batch.column(0).to_pylist()):
                yield from sums.add(np.concatenate([h, [START]]), np.concatenate([np.ones(len(h), np.int64), [0]]))
        yield from sums.out()

    counted = _by_bucket(texts.mapInArrow(lean(words, _FREED), _PACKED), few, f"{folder}/words", 1, "lm-words")
    if counted.most > 1 << (_ID_BITS - few):
        raise ValueError(f"{counted.most} words of a bucket are more than ids of {_ID_BITS} bits can tell")
    vocabulary, tokens, distinct = Table(few, 1, f"{folder}/words"), counted.sum, counted.positive

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(bits, 1)
        for batch in batches:
            for h, begins in token_chunks(batch.column(0).to_pylist()):
                known, inverse = np.unique(np.concatenate([h, [START]]), return_inverse=True)
                ids = vocabulary.find(known)[0].astype(np.uint64)[inverse]
                context = np.concatenate([ids[-1:], ids[:-2]])
                context[begins] = ids[-1]
                pair = mix64(context << np.uint64(32) | ids[:-1])
                yield from sums.add(pair, np.ones(len(pair), np.int64))
        yield from sums.out()

    seen = _by_bucket(texts.mapInArrow(lean(bigrams, _FREED), _PACKED), bits, f"{folder}/bigrams", 1, "lm-bigrams")
    pairs = Table(bits, 1, f"{folder}/bigrams")

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What each bigram says of its context (total and numbers of counts 1, 2, 3+) and of its word (a word before it).
        sums = _Sums(few, 5)
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                keys, counts = _columns(pairs.path(bucket), 1)
                for at in range(0, len(keys), 200_000):
                    pair, c = unmix64(keys[at : at + 200_000]), counts[at : at + 200_000].astype(np.int64)
                    zero = np.zeros(len(c), np.int64)
                    yield from sums.add(mix64(pair >> np.uint64(32)), np.stack([c, c == 1, c == 2, c > 2, zero], 1).astype(np.int64))
                    yield from sums.add(mix64(pair & np.uint64(0xFFFFFFFF)), np.stack([zero, zero, zero, zero, zero + 1], 1))
        yield from sums.out()

    _by_bucket(_of_buckets(spark, bits, statistics, _PACKED), few, f"{folder}/stats", 5, "lm-stats")
    stats, kinds = Table(few, 5, f"{folder}/stats"), seen.n

    def befores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(5, np.int64)
            for bucket in batch.column(0).to_pylist():
                n += np.bincount(np.minimum(_columns(stats.path(bucket), 5)[5], 5).astype(np.int64), minlength=6)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in n], ["n1", "n2", "n3", "n4", "n5"])

    found = _of_buckets(spark, few, befores, "n1 long, n2 long, n3 long, n4 long, n5 long").groupBy().sum().first()
    word_discounts = discounts(list(found[:4]))
    d1, d2, d3 = word_discounts
    mass = (d1 * found[0] + d2 * found[1] + d3 * sum(found[2:])) / kinds if kinds else 1.0
    return KneserNey(vocabulary, pairs, stats, tokens, distinct, discounts([seen.one, seen.two, seen.three, seen.four]), word_discounts, kinds, mass)


def score_kneser_ney(df: DataFrame, model: KneserNey, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, n_tokens, n_known, train_tokens, base_score, score of every whole text, and perplexity.

    base_score is that of the words alone, score the log10 probability by the model. A null or empty text is an end alone. Rows are worked on alone; other columns don't matter.
    The model that is sent has no more than folders and totals; workers map the bucket files that they need into memory."""
    from pyspark.sql import types as T

    names, shipped = tuple(keep), df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in batches:
            parts = list(held.score(batch.column(len(names)).to_pylist()))
            if parts:
                n, known, base, score = (np.concatenate(x) for x in zip(*parts))
                found = [n, known, np.full(len(n), held.tokens), base, score, 10 ** (-score / n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *map(pa.array, found)], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    out = [T.StructField(c, t()) for c, t in zip(("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"), (T.LongType,) * 3 + (T.DoubleType,) * 3)]
    return df.select(*names, F.col(text_col).cast("string").alias("__text")).mapInArrow(lean(work, _FREED), T.StructType([*(df.schema[c] for c in names), *out]))


def training_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that aren't held out."""
    return df.where(crc_mod(F.col(id_col), FOLDS) != 0)
