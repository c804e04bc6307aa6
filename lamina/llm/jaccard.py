"""Jaccard self-join of word shingle sets by PartEnum signatures, and the classes that its links make.

Two sets of sizes x and y with a Jaccard similarity of at least 0.8 differ in at most k = (x + y) / 9 elements. For a band of sizes and the band
above it the domain of shingle hashes is cut into groups of three partitions, more than k / 2 groups, so that in some group the two
sets differ in one element at most; then two of its three partitions are the same in both. The signatures of a set are the contents of all
pairs of partitions of each group, so sufficiently similar sets share one.

An empty pair of partitions tells nothing, so it gives no signature. There are SPARE groups over the number needed: a pair of sets is missed
only if both have more groups with an empty pair than are spare. Such sets, and those of small bands, also enumerate the singletons of their smallest
elements, as many as leave fewer than 80 percent of the set: two such sets that are similar share one of these. So no pair is lost at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lean, mix64, span_hashes, stored, text_bytes, word_spans
from lamina.llm.components import components

#: Words of a shingle.
SHINGLE = 5
#: Bounds on the differences from which partitions are enumerated, not singletons.
LEAST_BOUND = 8
#: Rows that a broadcast may have; larger sides are shuffled. Rows of a block of a group whose pairs are compared in one go.
MAX_BROADCAST, BLOCK = 1_000_000, 512

_K = np.uint64(0x9E3779B97F4A7C15)
_SINGLE = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 19
#: Signatures that a bucket has about, and that are held at most of one; pairs and words of parity bits compared at a time.
_BUCKET, _HELD, _PAIRS, _WORDS = 1 << 20, 4_000_000, 200_000, 1 << 18
#: Signatures of a bucket that go out in a row, and that go out of a task at a time at least and at most.
_ROW, _LEAST, _MOST = 2048, 1 << 16, 1 << 21
#: Nodes that share a signature from which a task tells it for itself.
_MANY = 16
#: Partitions at most that buckets are dealt to.
_PARTITIONS = 50_000
#: Less than this in the place of a bucket: sizes of sets.
SIZES = -(1 << 61)


def shingles(text) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: of all words together if there are fewer than SHINGLE, none without words."""
    data = np.frombuffer(text_bytes(text), np.uint8)
    return _of_words(span_hashes(data, *word_spans(data)))


def _of_words(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    g = np.full(n, width, np.uint64) * _K
    for k in range(width):
        g = mix64(g * _K + h[k : k + n])
    return np.unique(g)


def _sets(texts: list) -> Iterator[np.ndarray]:
    """shingles() of many texts; texts of a chunk are hashed together."""
    at = 0
    while at < len(texts):
        parts, size, to = [], 0, at
        while to < len(texts) and (size < _CHUNK or to == at):
            parts.append(text_bytes(texts[to]))
            size += len(parts[-1]) + 1
            to += 1
        data = np.frombuffer(b" ".join(parts), np.uint8)
        starts, ends = word_spans(data)
        h = span_hashes(data, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield _of_words(h[a:b])
        at = to


def least_common(total: np.ndarray | int):
    """The smallest intersection with which sets of so many elements together link: 100 * i >= 80 * (total - i)."""
    return -(-4 * total // 9)


def bands(most: int) -> list[int]:
    """First sizes of the bands up to one that has most: similar sets lie in the same band or in neighbours."""
    first = [1, 2]
    while first[-1] <= most:
        first.append(max(first[-1], (5 * (first[-1] - 1)) // 4) + 1)
    return first


_bands = bands(1000)


def _band(n: int) -> int:
    global _bands
    if _bands[-1] <= n:
        _bands = bands(2 * n)
    return int(np.searchsorted(_bands, n, side="right")) - 1


def bound(band: int) -> int:
    """The most differences of a similar pair with one set in the band and the other in it or the next one."""
    last = _bands[band + 1] - 1
    return (last + 5 * last // 4) // 9


def spare(groups: int) -> int:
    return math.ceil(0.04 * groups + 4 * math.sqrt(0.04 * groups))


def signatures(h: np.ndarray) -> np.ndarray:
    """The signatures of a set, given as sorted distinct hashes."""
    n = len(h)
    if not n:
        return h
    content = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ _K))])
    out, single = [mix64(content[-1:] + _SINGLE)], False  # equal sets share that of the whole
    top = h >> np.uint64(32)
    band = _band(n)
    for at in (band, band - 1):
        k = bound(at) if at >= 0 else 0
        if not k:
            continue  # only equal sets are so similar
        if k < LEAST_BOUND:
            single = True
            continue
        need = k // 2 + 1
        extra = spare(need)
        parts = 3 * (need + extra)
        cuts = np.searchsorted((top * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        sums = (content[cuts[1:]] - content[cuts[:-1]]).reshape(-1, 3)
        sizes = np.diff(cuts).reshape(-1, 3)
        pair_sizes = sizes.sum(1, keepdims=True) - sizes
        pair_sums = sums.sum(1, keepdims=True) - sums
        place = np.arange(parts, dtype=np.uint64).reshape(-1, 3) + (np.uint64(at + 1) << np.uint64(40))
        out.append(mix64(pair_sums + mix64(place * _K))[pair_sizes > 0])
        single |= int((pair_sizes == 0).any(1).sum()) > extra
    if single:
        out.append(mix64(h[: n - least_common_alone(n) + 1] ^ _SINGLE))
    return np.concatenate(out)


def least_common_alone(n: int) -> int:
    """Elements that a set of n shares with any similar set at least."""
    return -(-4 * n // 5)


def parity(h: np.ndarray) -> np.ndarray:
    """A bit for each class of hashes: whether the set has an odd number of them. Bits that differ between two sets are no more than elements that do."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").view(np.uint64)


def _fold(p: np.ndarray, words: int) -> np.ndarray:
    while p.shape[-1] > words:
        half = p.shape[-1] // 2
        p = p[..., :half] ^ p[..., half:]
    return p


class _Signed:
    """Signatures of a task, dealt to buckets by their first bits and packed: a row has those of one bucket.

    Of _MANY nodes that share a signature within what goes out together it's told here, and one of them alone is compared with those of other tasks, so that a signature that very many sets share
    has few rows for each batch and not one for each set."""

    def __init__(self, bits: int):
        self.bits, self.sigs, self.nodes, self.n = bits, [], [], 0
        self.most = min(max(_ROW << bits, _LEAST), _MOST)

    def add(self, node: int, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.sigs.append(signatures(h))
        self.nodes.append(node)
        self.n += len(self.sigs[-1])
        if self.n > self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            sig, lead, shared = _led(np.concatenate(self.sigs), np.repeat(np.array(self.nodes, np.int64), list(map(len, self.sigs))), _MANY)
            bucket = (sig >> np.uint64(64 - self.bits)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            yield _packed(bucket[first], np.append(first, len(sig)), sig, lead)
            # What is told already is spread evenly, by negative numbers.
            if len(shared[0]):
                cuts = np.append(np.arange(0, len(shared[0]), 100_000), len(shared[0]))
                yield _packed(-1 - (shared[0][cuts[:-1]] >> np.uint64(64 - self.bits)).astype(np.int64), cuts, *shared)
        self.sigs, self.nodes, self.n = [], [], 0


def _packed(bucket: np.ndarray, cuts: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with the stretches of the columns between its cuts as bytes; a third column that isn't there is empty."""
    offsets = pa.array((8 * cuts).astype(np.int32))
    packed = [pa.Array.from_buffers(pa.binary(), len(bucket), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(c))]) for c in columns]
    packed += [pa.array([b""] * len(bucket), pa.binary())] * (3 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(bucket), *packed], ["bucket", "x", "y", "z"])


def _led(sig: np.ndarray, node: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Rows sorted by signature, of those of many nodes or more the one of the smallest alone, and all rows (sig, node, smallest node) of these."""
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    lengths = np.diff(np.append(first, len(sig)))
    lead, told = np.repeat(np.minimum.reduceat(node, first), lengths), np.repeat(lengths >= many, lengths)
    stay = ~told
    stay[first] = True
    return sig[stay], np.where(told, lead, node)[stay], (sig[told], node[told], lead[told])


def _signed(bits: int):
    """For mapInArrow, of rows (node, th, th2, text): packed signatures, and the sizes of the sets (under SIZES in the place of a bucket) by the hashes of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = _Signed(bits)
        for batch in batches:
            sizes = []
            for node, h in zip(batch.column(0).to_pylist(), _sets(batch.column(3).to_pylist())):
                sizes.append(len(h))
                if node is not None:
                    yield from signed.add(node, h)
            if sizes:
                th = batch.column(1).to_numpy()
                yield _packed(np.array([SIZES - 1 - (int(th[0]) & 0xFFFFFFFF)]), np.array([0, len(sizes)]), th, batch.column(2).to_numpy(), np.array(sizes, np.int64))
        yield from signed.out()

    return work


def _rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 100_000):
        part = [pa.array(c[at : at + 100_000].view(np.int64)) for c in columns]
        yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(len(part[0]), kind, np.int32))], ["sig", "node", "lead", "kind"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows sorted by bucket those whose signature another node has too, with the smallest of its nodes: (sig, node, lead, 0); and the sizes (th, th2, n, 1).

    A bucket is held at a time. Where one outgrows _HELD, what is told goes out and a row for each signature stays; a signature then may have several leads."""
    parts, held, now = [], 0, None

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal parts, held
        if parts:
            sig, lead, shared = _led(*(np.concatenate(c) for c in zip(*parts)), 2)
            parts, held = [(sig, lead)], len(sig)
            yield from _rows(0, *shared)

    for batch in batches:
        x, y, z = (batch.column(i) for i in (1, 2, 3))
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            a, b, c = (np.frombuffer(v[i].as_buffer(), t) for v, t in ((x, np.uint64), (y, np.int64), (z, np.int64)))
            if bucket < 0:
                yield from _rows(int(bucket < SIZES), a, b, c)
                continue
            if bucket != now:
                yield from told()
                parts, held, now = [], 0, bucket
            parts.append((a.copy(), b.copy()))
            held += len(a)
            if held > _HELD and len(parts) > 1:
                yield from told()
    yield from told()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, both sets) the pairs that link."""
    for batch in batches:
        a, b = [], []
        for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
            if len(np.intersect1d(p, q, assume_unique=True)) >= least_common(len(p) + len(q)):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [h.tobytes() for h in _sets(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(_sets(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([parity(h).tobytes() for h in sets], pa.binary())], ["node", "n", "parity"])


def _pairs(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (i, j), i < j, of all pairs within groups of rows, some _PAIRS at a time."""
    later = np.repeat(starts + sizes, sizes) - 1 - np.arange(sizes.sum()) - np.repeat(starts - np.cumsum(sizes) + sizes, sizes)  # rows after each in its group
    rows = np.arange(len(later)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    upto = np.cumsum(later)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        n = later[at:to]
        i = np.repeat(rows[at:to], n)
        yield i, i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, component, side, size, parity) sorted by key the pairs of different components that may link by size and parity.

    Groups are compared together, those of a batch at a time; a group that goes on into the next batch waits for its end. A group has two blocks at most."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, comp, side, size = (table.column(i).to_numpy() for i in range(5))
        parities = pa.concat_arrays(table.column(5).chunks)
        ends = np.frombuffer(parities.buffers()[1], np.int32)[parities.offset : parities.offset + len(parities) + 1].astype(np.int64) // 8
        bits, words = np.frombuffer(parities.buffers()[2], np.uint64), np.diff(ends)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        two = np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first)
        crossed = np.repeat(two, sizes)  # whether only rows of different sides are compared
        names, local = np.unique(node, return_inverse=True)
        several = sizes > 1
        for i, j in _pairs(sizes[several], first[several]) if several.any() else ():
            good = (comp[i] != comp[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])) & (~crossed[i] | (side[i] != side[j]))
            i, j = i[good], j[good]
            # The same two nodes under several keys are compared once.
            lo, hi = np.minimum(local[i], local[j]), np.maximum(local[i], local[j])
            _, once = np.unique(lo * len(names) + hi, return_index=True)
            i, j = i[once], j[once]
            swap = words[i] > words[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            total = size[i] + size[j]
            most = total - 2 * least_common(total)
            near = np.zeros(len(i), bool)
            for w, v in np.unique(np.stack([words[i], words[j]], 1), axis=0).tolist() if len(i) else ():
                at = np.flatnonzero((words[i] == w) & (words[j] == v))
                step = max(1, _WORDS // v)
                for k in range(0, len(at), step):
                    some = at[k : k + step]
                    apart = bits[ends[i[some]][:, None] + np.arange(w)] ^ _fold(bits[ends[j[some]][:, None] + np.arange(v)], w)
                    near[some] = np.bitwise_count(apart).sum(1, dtype=np.int64) <= most[some]
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i[near]], node[j[near]])), pa.array(np.minimum(node[i[near]], node[j[near]]))], ["a", "b"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        # Up to the last group, which may go on; what waits is of one group.
        cut = int(np.searchsorted(key, key[-1]))
        if cut == 0 and waiting and waiting[0].column(0)[0].as_py() == key[0]:
            waiting.append(batch)
            continue
        if cut or waiting:
            yield from compare(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
        waiting = [batch.slice(cut)]
    if waiting:
        yield from compare(pa.Table.from_batches(waiting))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The classes of documents that links of similar shingle sets make.

    Returns for each row the column named id_col, n_shingles long (size of its set) and component_id long (the smallest id reachable by links, its own
    included). A null or empty text, or one without words, has an empty set and links with nothing. Repeated rows each give a row. An id with several texts
    is linked by each of them. Rows with a null id have a null component_id and link nothing. Other columns of df don't matter; id_col is read as bigint.

    Rows with equal texts are one node. Nodes go by their signatures: first each is compared with the smallest node that shares most of its signatures, which joins
    groups of copies without their pairs; then nodes that share a signature and aren't joined yet are compared in blocks, by size and parity bits, then exactly."""
    texts = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.select("doc", F.xxhash64("text").alias("th"), F.xxhash64("text", F.lit(1)).alias("th2"), "text")
    own = stored(keyed.select("doc", "th", "th2", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size")), "own")
    nodes = stored(own.groupBy("th", "th2").agg(F.min("doc").alias("node"), F.max("size").alias("size"), F.count("*").alias("times")), "nodes")
    words = (nodes.agg(F.sum("size")).first()[0] or 0) // 5  # about as many as there are signatures
    bits = max(3, (words // _BUCKET).bit_length())
    # All rows but one of each text; those without an id only if their text stands nowhere else.
    repeated = nodes.where("times > 1").select("th", "th2", "node")
    copies = stored(own.join(_small(repeated), ["th", "th2"]).where("NOT doc <=> node").select("doc", "th", "th2").distinct(), "copies")
    kept = keyed.join(_small(copies), keyed["doc"].eqNullSafe(copies["doc"]) & (keyed["th"] == copies["th"]) & (keyed["th2"] == copies["th2"]), "left_anti")
    signed = kept.mapInArrow(lean(_signed(bits)), "bucket long, x binary, y binary, z binary")
    # A partition for each bucket, so that none has several by chance.
    partitions = min(1 << bits, _PARTITIONS)
    dealt = signed.repartitionById(partitions, F.pmod("bucket", F.lit(partitions)).cast("int"))
    found = stored(dealt.sortWithinPartitions("bucket").mapInArrow(lean(_shared), "sig long, node long, lead long, kind int"), "shared")
    shared = found.where("kind = 0")
    sizes = found.where("kind = 1").select(F.col("sig").alias("th"), F.col("node").alias("th2"), F.col("lead").alias("n")).distinct()

    def of_nodes(ids: DataFrame) -> DataFrame:
        wanted = _small(nodes.join(ids, "node", "left_semi").select("node", "th", "th2"))
        return keyed.join(wanted, (keyed["doc"] == wanted["node"]) & (keyed["th"] == wanted["th"]) & (keyed["th2"] == wanted["th2"])).select("node", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = stored(of_nodes(ids).mapInArrow(lean(_with_sets), "node long, hashes binary"), "sets")
        one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lean(_linked), "a long, b long"), "links")

    def nearest(pairs: DataFrame) -> DataFrame:
        """Of rows (node, lead), one for each signature, the links of nodes with the lead of most of them."""
        often = pairs.groupBy("node", "lead").agg(F.count("*").alias("c"))
        best = often.groupBy("node").agg(F.max(F.struct("c", (-F.col("lead")).alias("m"))).alias("x")).select(F.col("node").alias("a"), (-F.col("x.m")).alias("b"))
        return verified(stored(best, "best"))

    links = nearest(shared.where("node <> lead").select("node", "lead"))
    # An id with several texts, of which some are another node's.
    several = own.where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select("doc")
    links = links.union(copies.where("doc IS NOT NULL").join(several, "doc", "left_semi").join(nodes, ["th", "th2"]).select(F.col("doc").alias("a"), F.col("node").alias("b")))

    def mixed_rows(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The shared rows with the classes so far, and the signatures that several classes share."""
        classed = shared.select("sig", "node").join(joined, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        return classed, classed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("sig", "lo", "c")

    # Then with the smallest node of the classes that share most of them.
    classed, mixed = mixed_rows(components(links))
    links = links.union(nearest(classed.join(mixed, "sig").where("component <> lo").select("node", F.col("lo").alias("lead"))))
    # Nodes that share a signature and lie in different classes even so.
    classed, mixed = mixed_rows(components(links))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rows = classed.join(mixed, "sig").select("sig", "node", "component", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("side"), blocks.alias("blocks"))
    rows = rows.select("sig", "node", "component", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = stored(rows.select(F.xxhash64("sig", F.least("side", "other"), F.greatest("side", "other")).alias("key"), "node", "component", "side").distinct(), "mixed")
    parities = stored(of_nodes(rows.select("node").distinct()).mapInArrow(lean(_parities), "node long, n long, parity binary"), "parity")
    near = rows.join(parities, "node").select("key", "node", "component", "side", "n", "parity").repartition("key").sortWithinPartitions("key", "node").mapInArrow(lean(_close), "a long, b long")
    more = verified(stored(near.distinct(), "near"))
    classes = components(links.union(more))
    known = nodes.select("th", "th2", "node", "times").join(sizes, ["th", "th2"]).join(classes, "node", "left").select("th", "th2", "times", "n", F.coalesce("component", "node").alias("component"))
    known = stored(known, "known")
    # A text that very many rows have is joined by a broadcast while the repeated texts are within its bound.
    several = known.where("times > 1").drop("times")
    rows = own.select("doc", "th", "th2")
    once = rows.join(_small(several), ["th", "th2"], "left_anti").join(known.where("times = 1").drop("times"), ["th", "th2"])
    placed = once.unionByName(rows.join(_small(several), ["th", "th2"]))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return placed.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
