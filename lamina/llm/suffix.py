"""Removal of repeated byte strings by ranks of sampled positions, in place of prefix doubling over all of them.

Doubling sorts a row for each byte of text a round: measured, 16 times the compressed input in the shuffle of its first round alone, where the budget of all is four times (README). So ranks are made
for sampled positions. Names of GRAM bytes are ranks that doubling would come to in five rounds; of the starts in each string of LENGTH bytes the position with the smallest name stands for them all, which
is the same in each copy of the string. Spark sorts (name, position); a position with a name of its own is unique and drops out. The others get the rank pair of their name and of the whole context that they
stand for, up to 168 bytes, and are sorted by it: in a class of equal pairs all but the first are repeats, and where a name has one class alone the first is settled too. Only where a name
has several classes, which is at the edges of repeats, the starts that the first of each class stands for are ranked by all their LENGTH bytes and sorted a last
time. So each round sorts fewer positions, ranks past the threshold are never made, and the result is that of comparing all strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import _BYTE, _power_tables, lean, mix64, shared_path, stored
from lamina.llm.lm import _PARTITIONS, _mapped, _save

#: Bytes of a string that counts as repeated, and of the names that ranks start from.
LENGTH, GRAM = 100, 32
#: Rows that a broadcast may have; larger sides are shuffled. Bytes of text worked on at a time, entries of a bucket file.
MAX_BROADCAST, _CHUNK, _ENTRIES = 1_000_000, 1 << 20, 400_000
#: Positions of which repeats are found before they are shuffled.
_TOGETHER = 400_000

_STARTS = LENGTH - GRAM + 1
_PLACE = np.uint64((1 << 30) - 1)
_K, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LAST = (1 << 63) - 1


class Hashed:
    """Running sums of a byte array, from which any stretch has a name."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.total = np.empty(len(data) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.total[1:])

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _SALT)


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after another in data, with bounds between them: for each position that stands for starts of strings its text, name, context's name, place in the text, and
    how far before and after it the first and last start lie that it stands for."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    hashed = Hashed(data)
    at = np.arange(n - GRAM + 1)
    gram = mix64((hashed.total[GRAM:] - hashed.total[: n - GRAM + 1]) * hashed.inverse[: n - GRAM + 1])
    key = (gram & ~_PLACE) | at.astype(np.uint64)
    # The smallest of _STARTS successive keys by doubling; of equal names the first, as the place is in the low bits.
    least, width = key, 1
    while width * 2 <= _STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _STARTS - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    starts = np.arange(len(least))
    text = np.searchsorted(bounds, starts, side="right") - 1
    good = starts + LENGTH <= bounds[text + 1]
    starts, text, chosen = starts[good], text[good], (least[good] & _PLACE).astype(np.int64)
    if not len(starts):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, a, of = starts[first], starts[last], chosen[first], text[first]
    context = mix64(hashed.names(lo, hi + LENGTH) + (a - lo).astype(np.uint64) * _K)
    return of, gram[a], context, a - bounds[of], a - lo, hi - a


def _chunks(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in chunks: the first one's place, their bytes one after another, the bounds between them."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at + len(parts) < len(texts) and (size < _CHUNK or not parts):
            t = texts[at + len(parts)]
            parts.append(b"" if t is None else t.encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
        yield at, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        at += len(parts)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranked positions. Of equal classes within a batch the first alone needs comparing with others: the rest are repeats already, and go out with a name that spreads them evenly and a
    negative k, so that a passage that stands everywhere has a row for each batch under its name, not one for each text."""
    for batch in batches:
        doc, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts: list[tuple[np.ndarray, ...]] = []
        for first, data, bounds in _chunks(batch.column(2).to_pylist()):
            if len(data) > int(_PLACE):
                raise ValueError(f"a text of {len(data)} bytes: places have {int(_PLACE).bit_length()} bits")
            of, gram, context, place, before, after = anchors(data, bounds)
            if len(of):
                # A place with the starts before and after it in one number, in the order of places.
                parts.append((gram, context, doc[first + of], k[first + of], place << 20 | before << 10 | after + 512))
            if parts and sum(len(x[0]) for x in parts) > _TOGETHER:
                yield _settled(parts)
                parts = []
        if parts:
            yield _settled(parts)


def _once(*columns: np.ndarray, last: tuple | None = None) -> list[np.ndarray]:
    """Sorted rows without those equal to the row before (to last, of the first one): rows that repeat id and text have the same positions, which are no repeats of each other."""
    new = np.zeros(len(columns[0]), bool)
    if not len(new):
        return list(columns)
    new[0] = last is None or any(c[0] != x for c, x in zip(columns, last))
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in columns]


def _settled(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    g, f, doc, k, at = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((at, k, doc, f, g))
    g, f, doc, k, at = _once(*(x[order] for x in (g, f, doc, k, at)))
    again = np.concatenate([[False], (g[1:] == g[:-1]) & (f[1:] == f[:-1])])
    spread = mix64(doc.view(np.uint64) + at.view(np.uint64) * _K)
    return _batch(["g", "f", "doc", "k", "at"], np.where(again, spread, g), f, doc, np.where(again, -1 - k, k).astype(np.int32), at)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name, class and position: repeats (settled true), and the firsts of classes whose name has others (settled false). Between batches the last row and at most one first are kept."""
    last, waiting, many = None, None, False  # last: a whole row
    for batch in batches:
        g, f, doc, k, at = (batch.column(i).to_numpy() for i in range(5))
        if (known := k < 0).any():
            yield _batch(["g", "doc", "k", "at", "settled"], np.zeros(known.sum(), np.int64), doc[known], (-1 - k[known]).astype(np.int32), at[known], np.full(known.sum(), True))
            g, f, doc, k, at = (x[~known] for x in (g, f, doc, k, at))
        g, f, doc, k, at = _once(g, f, doc, k, at, last=last)
        if not len(g):
            continue
        new_g = np.concatenate([[last is None or last[0] != g[0]], g[1:] != g[:-1]])
        new_f = new_g | np.concatenate([[last is None or last[1] != f[0]], f[1:] != f[:-1]])
        rows = np.stack([g, doc, k, at], 1)
        leads = np.flatnonzero(new_f)
        group = np.cumsum(new_g)  # 0 for the name that goes on from the batch before
        lead_group = group[leads]
        counts = np.bincount(lead_group, minlength=group[-1] + 1)
        mixed = counts[lead_group] > 1
        out = []
        if counts[0]:  # firsts of further classes of that name
            mixed |= lead_group == 0
            if waiting is not None:
                out.append(waiting)
            waiting, many = None, True
        if group[-1]:
            ends = counts[-1]
            waiting, many = (None, True) if ends > 1 else (rows[leads[-1]][None], False)
        out.append(rows[leads[mixed]])
        repeats, found = rows[~new_f], np.concatenate(out)
        last = (g[-1], f[-1], doc[-1], k[-1], at[-1])
        for part, settled in ((repeats, True), (found, False)):
            if len(part):
                yield _batch(["g", "doc", "k", "at", "settled"], np.zeros(len(part), np.int64) if settled else part[:, 0], part[:, 1], part[:, 2].astype(np.int32), part[:, 3], np.full(len(part), settled))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by rank and position all but the first of each rank."""
    last = None
    for batch in batches:
        w, doc, k, p = (batch.column(i).to_numpy() for i in range(4))
        known = k < 0
        again = [(doc[known], -1 - k[known], p[known])]
        w, doc, k, p = _once(*(x[~known] for x in (w, doc, k, p)), last=last)
        if len(w):
            same = np.concatenate([[last is not None and last[0] == w[0]], w[1:] == w[:-1]])
            again.append((doc[same], k[same], p[same]))
            last = (w[-1], doc[-1], k[-1], p[-1])
        doc, k, p = (np.concatenate(x) for x in zip(*again))
        if len(doc):
            yield _batch(["doc", "k", "start", "end"], doc, k.astype(np.int32), p, p + LENGTH)


def _keys(doc: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mix64(doc.view(np.uint64) + k.astype(np.uint64) * _K)


@dataclass
class Lists:
    """Lists of pairs of numbers by document, in bucket files of sorted keys, which are named by their number."""

    bits: int
    folder: str

    @classmethod
    def write(cls, df: DataFrame, folder: str, label: str) -> Lists:
        """Of rows (doc, k, x, y)."""
        bits = max(3, int(df.count() // _ENTRIES).bit_length())
        folder = f"{folder}/{label}"

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, k, x, y = (batch.column(i).to_numpy() for i in range(4))
                yield _batch(["h", "x", "y"], _keys(doc, k), x, y)

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[tuple[np.ndarray, ...]] = []
            bucket, n = -1, 0

            def close() -> None:
                if parts:
                    _save(f"{folder}/{bucket}.bin", *(np.concatenate(c) for c in zip(*parts)))
                parts.clear()

            for batch in batches:
                h, x, y = (batch.column(i).to_numpy() for i in range(3))
                n += len(h)
                of = (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if b > a:
                        if of[a] != bucket:
                            close()
                            bucket = int(of[a])
                        parts.append((h[a:b].copy(), x[a:b].copy(), y[a:b].copy()))
            close()
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

        keys = df.select("doc", "k", "x", "y").mapInArrow(lean(keyed), "h long, x long, y long")
        partitions = min(1 << bits, _PARTITIONS)
        dealt = keys.repartitionById(partitions, F.pmod(F.shiftrightunsigned("h", 64 - bits), F.lit(partitions)).cast("int")).sortWithinPartitions(F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
        stored(dealt.mapInArrow(lean(save), "n long"), label)
        return cls(bits, folder)

    def find(self, key: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a document, by its key."""
        none = np.zeros(0, np.int64)
        data = _mapped(f"{self.folder}/{int(key) >> (64 - self.bits)}.bin")
        n = len(data) // 24
        h = data[: 8 * n].view(np.uint64)
        a, b = np.searchsorted(h, key, "left"), np.searchsorted(h, key, "right")
        return (data[8 * (n + a) : 8 * (n + b)].view(np.int64), data[8 * (2 * n + a) : 8 * (2 * n + b)].view(np.int64)) if b > a else (none, none)


def _windows(wanted) -> callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = wanted.value
        for batch in batches:
            doc, k, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            keys = _keys(doc, k)
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for i in range(len(doc)):
                g, at = lists.find(keys[i])
                if not len(at):
                    continue
                data = np.frombuffer((texts[i].as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                place, before, after = at >> 20, at >> 10 & 1023, (at & 1023) - 512
                count = before + after + 1
                start = np.repeat(place - before, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                rank = mix64(Hashed(data).names(start, start + LENGTH) + np.repeat(g.view(np.uint64), count) * _K + (np.repeat(place, count) - start).astype(np.uint64))
                held.append((rank.view(np.int64), np.full(len(start), doc[i]), np.full(len(start), k[i], np.int32), start))
                size += len(start)
                if size > _TOGETHER:
                    yield _ranked(held)
                    held, size = [], 0
            if held:
                yield _ranked(held)

    return work


def _ranked(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Ranked starts, of equal ranks all but the first marked as in _named."""
    w, doc, k, start = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((start, k, doc, w))
    w, doc, k, start = _once(*(x[order] for x in (w, doc, k, start)))
    again = np.concatenate([[False], w[1:] == w[:-1]])
    spread = mix64(doc.view(np.uint64) + start.view(np.uint64) * _K).view(np.int64)
    return _batch(["w", "doc", "k", "start"], np.where(again, spread, w), doc, np.where(again, -1 - k, k).astype(np.int32), start)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that intervals cover."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove from each text, as UTF-8, every byte covered by a string of LENGTH bytes that also starts earlier.

    Returns the column named id_col, those named in keep, n_bytes, n_removed, n_spans (bigint; maximal removed runs) and kept binary (the bytes that stay, one after another). Earlier means in a row of a
    smaller id, or in the same text at an earlier start; rows of one id with different texts come in the order of their hashes, rows without an id last, and rows that repeat both id and text
    count as one and each get its result. Null and empty texts, and those under LENGTH bytes, stay as they are. Other columns don't matter.

    Texts aren't shuffled: names and places are, once for one position in about 35, and lists of places by document lie in bucket files that the workers map into memory."""
    spark = df.sparkSession
    folder = shared_path(spark, "suffix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__keep_{c}") for c in keep), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    texts = stored(rows.select("doc", "th", F.xxhash64("text", F.lit(1)).alias("th2"), F.octet_length("text").cast("bigint").alias("size")).distinct(), "texts")
    # Ids with several texts: their order among them.
    several = texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    ranked = stored(texts.join(several, "doc", "left_semi").withColumn("k", (F.row_number().over(Window.partitionBy("doc").orderBy("th", "th2")) - 1).cast("int")).select("doc", "th", "k"), "ranked")
    n = ranked.count()

    def placed(x: DataFrame) -> DataFrame:
        if not n:
            return x.withColumn("k", F.lit(0))
        return x.join(F.broadcast(ranked) if n <= MAX_BROADCAST else ranked, ["doc", "th"], "left").withColumn("k", F.coalesce("k", F.lit(0)))

    # Copies of whole texts: the first one stays, of the others all is removed, and they needn't be looked at.
    own = placed(texts)
    firsts = own.groupBy("th", "th2", "size").agg(F.min(F.struct("doc", "k")).alias("m"), F.count("*").alias("n")).where("n > 1").select("th", "th2", "size", "m")
    copies = stored(own.where(f"size >= {LENGTH}").join(firsts, ["th", "th2", "size"]).where("doc <> m.doc OR k <> m.k").select("doc", "k", "size"), "copies")
    gone = copies.select("doc", "k")
    once = placed(rows.select("doc", "th", "text")).where(F.octet_length("text") >= LENGTH).join(F.broadcast(gone) if copies.count() <= MAX_BROADCAST else gone, ["doc", "k"], "left_anti").select("doc", "k", "text")
    named = once.mapInArrow(lean(_named), "g long, f long, doc long, k int, at long")
    classes = stored(named.repartition("g").sortWithinPartitions("g", "f", "doc", "k", "at").mapInArrow(lean(_classes), "g long, doc long, k int, at long, settled boolean"), "classes")
    wanted = Lists.write(classes.where("NOT settled").select("doc", "k", F.col("g").alias("x"), F.col("at").alias("y")), folder, "wanted")
    windows = once.mapInArrow(lean(_windows(spark.sparkContext.broadcast(wanted))), "w long, doc long, k int, start long")
    later = windows.repartition("w").sortWithinPartitions("w", "doc", "k", "start").mapInArrow(lean(_later), "doc long, k int, start long, end long")
    place = F.shiftright("at", 20)
    first, last = place - F.shiftright("at", 10).bitwiseAND(F.lit(1023)), place + F.col("at").bitwiseAND(F.lit(1023)) - 512 + LENGTH
    repeats = classes.where("settled").select("doc", "k", first.alias("x"), last.alias("y")).union(copies.select("doc", "k", F.lit(0).cast("bigint"), "size"))
    found = Lists.write(stored(repeats.union(later), "repeats").toDF("doc", "k", "x", "y"), folder, "repeats")
    shipped = spark.sparkContext.broadcast(found)
    names = [id_col, *keep]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shipped.value
        for batch in batches:
            c = len(names)
            keys = _keys(batch.column(c).to_numpy(), batch.column(c + 1).to_numpy())
            out: list[tuple] = []
            for key, t in zip(keys, batch.column(c + 2)):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                a, b = merged(*lists.find(key))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(a), kept))
            if out:
                columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(c)), *columns], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return placed(rows).select("__id", *(f"__keep_{c}" for c in keep), "doc", "k", "text").mapInArrow(lean(cut), schema)
