"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a batch are merged together, not one by one: every adjacent pair of symbols is kept in an index from pair to
all its positions in the batch. The pair with the lowest active rank is taken, merged at each of its positions in
ascending order, and only the lists of the pairs beside those positions are updated. Each distinct word is merged once
for a batch, however often it occurs.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import lean

# Fixed values of the public byte-level scheme: the pattern that splits text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Code points that the installed regex module counts as letters or digits and the public tokenizers library,
# which follows an earlier Unicode version, as neither.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)

#: Distinct words whose ids a worker keeps, and bytes of text that it works on at a time.
CACHE_WORDS, CHUNK_BYTES = 100_000, 1 << 20


def _split_patterns() -> tuple:
    late = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
    letter, digit = rf"[\p{{L}}--[{late}]]", rf"[\p{{N}}--[{late}]]"
    exact = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{late}]|[^\s\p{{L}}\p{{N}}])").replace(r" ?\p{L}+", f" ?{letter}+").replace(r" ?\p{N}+", f" ?{digit}+")
    return regex.compile(SPLIT).findall, regex.compile("(?V1)" + exact).findall, regex.compile(f"[{late}]").search


def _near_pattern() -> tuple:
    """The same pattern for texts below U+0250 in the faster re module, and a search for characters beyond."""
    letter, digit, space = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \\x85\\xa0"
    near = f" ?[{letter}]+| ?[{digit}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(near).findall, re.compile("[^\x00-\u024f]").search


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and added tokens of a tokenizer file."""

    def __init__(self, text: str):
        model = (spec := json.loads(text))["model"]
        letters = _byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.added = {t: i for t, i in added.items() if t}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.pieces = {i: token for token, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for line in model["merges"]:
            left, right = (bytes(letters[c] for c in x) for x in (line.split(" ") if isinstance(line, str) else line))
            self.rank.setdefault((ids[left], ids[right]), len(self.merged))
            self.merged.append(ids[left + right])
        self.fast, self.exact, self.late = _split_patterns()
        self.near, self.far = _near_pattern()
        # Pairs as sorted numbers with their ranks, for whole arrays; whether no merge can bring up a pair that ranks before it.
        pairs = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], np.fromiter(self.rank.values(), np.int64)[order]
        self.sides = {r: p for p, r in self.rank.items()}
        first: dict[int, int] = {}
        for token, r in zip(self.merged, range(len(self.merged))):
            first.setdefault(token, r)
        self.ordered = all(first.get(x, -1) < r for p, r in self.rank.items() for x in p)

    def words(self, text: str) -> list[str]:
        """The parts of text that merges don't cross."""
        if text.isascii() or not self.far(text):
            return self.near(text)
        return self.exact(text) if self.late(text) else self.fast(text)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers; each pair is merged at all its positions at once."""
        if not self.ordered or not words or not len(self.pairs):
            return [np.asarray(x, "<u4").tobytes() for x in self.merge(words)]
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        symbol = np.asarray(self.byte_ids, np.int64)[data]
        symbol[ends] = -1  # no pair spans two words
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        where: dict[int, list[np.ndarray]] = {}

        def index(ranks: np.ndarray, places: np.ndarray) -> list[int]:
            """Enter positions in the lists of their pairs; the pairs that had none."""
            good = ranks >= 0
            ranks, places = ranks[good], places[good]
            if not len(ranks):
                return []
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            new = []
            for r, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
                if r in where:
                    where[r].append(places[a:b])
                else:
                    where[r] = [places[a:b]]
                    new.append(r)
            return new

        active = index(self._ranks(symbol[:-1], symbol[1:]), np.arange(n - 1))
        heapify(active)
        while active:
            r = heappop(active)
            (left, right), new, lists = self.sides[r], self.merged[r], where.pop(r)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            places = places[symbol[places] == left]
            second = after[places]
            good = symbol[second] == right
            places, second = places[good], second[good]
            if left == right and len(places) > 1:  # of overlapping positions the first is taken, then every other one
                taken, last = [], -1
                for k, (i, j) in enumerate(zip(places.tolist(), second.tolist())):
                    if i != last:
                        taken.append(k)
                        last = j
                places, second = places[taken], second[taken]
            if not len(places):
                continue
            beyond, ahead = after[second], before[places]
            symbol[places], symbol[second] = new, -2
            after[places] = beyond
            before[beyond] = places  # a word's end mark is always beyond
            ahead = before[places]
            ahead, own = ahead[ahead >= 0], places[ahead >= 0]
            for x in index(np.concatenate([self._ranks(symbol[places], symbol[beyond]), self._ranks(symbol[ahead], symbol[own])]), np.concatenate([places, ahead])):
                heappush(active, x)
        kept = symbol >= 0
        total = np.concatenate([[0], np.cumsum(kept)])
        ids = symbol[kept].astype("<u4").tobytes()
        starts = (total[ends - sizes] * 4).tolist()
        return [ids[a:b] for a, b in zip(starts, (total[ends] * 4).tolist())]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by the pair occurrence index over all of them, position by position: right for any order of ranks."""
        ids, rank, merged = self.byte_ids, self.rank, self.merged
        symbol: list[int] = []
        bounds = [0]
        for w in words:
            symbol += [ids[b] for b in w]
            symbol.append(-1)  # no pair spans two words
            bounds.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(symbol, symbol[1:])):
            if pair in rank:
                where.setdefault(pair, []).append(i)
        active = [(rank[p], p) for p in where]
        heapify(active)
        while active:
            r, pair = heappop(active)
            left, right = pair
            new = merged[r]
            places = sorted(where.pop(pair))
            for k, i in enumerate(places):
                j = after[i]
                if symbol[i] != left or j >= n or symbol[j] != right:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = new, -2
                after[i] = j2 = after[j]
                lower = False
                if j2 < n:
                    before[j2] = i
                    if (p := (new, symbol[j2])) in rank:
                        if p in where:
                            where[p].append(i)
                        else:
                            where[p] = [i]
                            heappush(active, (rank[p], p))
                        lower |= rank[p] < r
                if (h := before[i]) >= 0 and (p := (symbol[h], new)) in rank:
                    if p in where:
                        where[p].append(h)
                    else:
                        where[p] = [h]
                        heappush(active, (rank[p], p))
                    lower |= rank[p] < r
                if lower and k + 1 < len(places):  # a pair that ranks before this one has come up: it goes first
                    where[pair] = places[k + 1 :] + where.get(pair, [])
                    heappush(active, (r, pair))
                    break
        return [[s for s in symbol[a : b - 1] if s != -2] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special = {t: array("I", [i]).tobytes() for t, i in self.added.items()}
        split: list[list[str]] = []
        for text in texts:
            if self.added_split and any(t in text for t in special):
                parts: list[str] = []
                for part in self.added_split(text):
                    parts += [part] if part in special else self.words(part)
                split.append(parts)
            else:
                split.append(self.words(text))
        new = list({w for words in split for w in words}.difference(cache, special))
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list({w for words in split for w in words}.difference(special))
        cache.update(zip(new, self.merge_all([w.encode("utf-8") for w in new])))
        cache.update(special)
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD, unknown ids nothing."""
        get = self.pieces.get
        try:
            return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        except KeyError:
            return b"".join(get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(text: str) -> Vocabulary:
    """One parsed copy for each worker process."""
    if (key := hash(text)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def _chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    chunk: list[str] = []
    size = 0
    for t in texts:
        chunk.append(t or "")
        size += len(chunk[-1])
        if size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _fields(df: DataFrame, names: tuple[str, ...]) -> list[T.StructField]:
    return [df.schema[c] for c in names]


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """Encode every whole text.

    Returns the columns named in keep, then ids binary (little-endian unsigned 32-bit) and n_tokens long, and with decode=True
    also decoded string, made from the ids alone. A null text counts as empty: no ids, an empty decoded text. Repeated rows
    give repeated results, an empty table gives an empty one, other columns of df don't matter. The tokenizer file is read
    once on the driver (its size is that of a vocabulary, whatever the corpus) and reaches each worker with the function."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shipped = df.sparkSession.sparkContext.broadcast(spec)
    names = tuple(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shipped.value)
        cache: dict[str, bytes] = {}
        for batch in batches:
            at = 0
            for chunk in _chunks(x.as_py() for x in batch.column(len(names))):
                ids = vocabulary.encode(chunk, cache)
                part = batch.slice(at, len(chunk))
                at += len(chunk)
                columns = [part.column(i) for i in range(len(names))]
                columns += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decode:
                    columns.append(pa.array([vocabulary.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids", "n_tokens", *["decoded"] * decode])

    schema = T.StructType([*_fields(df, names), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decode)
    return df.select(*names, F.col(text_col).alias("__text")).mapInArrow(lean(work), schema)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decode ids (binary, little-endian unsigned 32-bit) to text, in a column decoded; null ids give an empty text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())
    names = tuple(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shipped.value)
        for batch in batches:
            found = pa.array([vocabulary.decode(x.as_py() or b"") for x in batch.column(len(names))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), found], [*names, "decoded"])

    schema = T.StructType([*_fields(df, names), T.StructField("decoded", T.StringType())])
    return df.select(*names, F.col(ids_col).alias("__ids")).mapInArrow(lean(work), schema)
