import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import suffix as S
from lamina.llm.queries import repeat_digest
from lamina.llm.suffix import merged, remove_repeats


def brute(rows):
    """rows: (id, text) in their order."""
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        cover = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                cover[p : p + 100] = True
            seen.add(s)
        edge = np.diff(np.concatenate([[0], cover.astype(int)]))
        kept = bytes(b for b, c in zip(data, cover) if not c)
        out[i] = (len(data), int(cover.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "d", "épsilon", "日本", "zeta zeta"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    passages = [prose(n) for n in (13, 14, 20, 60)]
    docs = ["a" * 500, "ab" * 300, "abc" * 20, None, "", "x" * 99, "x" * 100, "x" * 101, "y" * 100, "y" * 100]
    for _ in range(60):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 12))]
        docs.append(" ".join(parts))
    for _ in range(25):
        d = list(rng.choice(docs[10:]))
        for _ in range(rng.choice([0, 1, 3])):
            d[rng.randrange(len(d)) : rng.randrange(len(d))] = rng.choice(["", "!", "é"])
        docs.append("".join(d))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,entries", [(1, 400_000), (2, 10)])
def test_against_brute_force(spark, monkeypatch, seed, entries):
    monkeypatch.setattr(S, "_ENTRIES", entries)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digest(df).collect()}
    assert got == brute(rows)


def test_repeated_and_missing_ids(spark):
    long = "the quick brown fox jumps over the lazy dog " + " ".join(map(str, range(60)))
    rows = [(7, long), (7, long), (3, "other " + long), (3, long), (None, long), (None, None)]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    n = len(long)
    assert len(got) == 6 and got.count((7, n, n)) == 2 and (None, n, n) in got and (None, 0, 0) in got
    # Of the two texts of one id the one whose hash is smaller comes first; the other loses what they share.
    assert sorted(r for i, _, r in got if i == 3) == [0, n]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_columns_and_bytes(spark):
    df = spark.createDataFrame([(1, "z" * 150 + "end", "p"), (2, "z" * 150, "q")], "doc_id long, text string, doc string")
    got = {r.doc_id: (r.doc, bytes(r.kept)) for r in remove_repeats(df, keep=("doc",)).collect()}
    # Of 150 equal bytes the first alone isn't in a string that starts later than an equal one.
    assert got == {1: ("p", b"zend"), 2: ("q", b"")}


def test_classes_over_batches():
    rng = random.Random(3)
    rows = sorted({(rng.randint(0, 25), rng.randint(0, 3), rng.randint(0, 9), 0, rng.randint(0, 99)) for _ in range(200)})
    want_repeats = {r for i, r in enumerate(rows) if i and rows[i - 1][:2] == r[:2]}
    want_mixed = {r for r in rows if r not in want_repeats and len({x[1] for x in rows if x[0] == r[0]}) > 1}
    for size in (1, 2, 3, 17, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + size]]) for j in range(5)], list("gfdka")) for i in range(0, len(rows), size)]
        out = [tuple(x) for b in S._classes(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted((d, k, a) for _, d, k, a, s in out if s) == sorted(r[2:] for r in want_repeats)
        assert sorted((g, d, k, a) for g, d, k, a, s in out if not s) == sorted((r[0], *r[2:]) for r in want_mixed)


def test_merged():
    a, b = merged(np.array([5, 0, 3, 20]), np.array([9, 4, 5, 30]))
    assert a.tolist() == [0, 20] and b.tolist() == [9, 30]


@pytest.mark.parametrize("parts", [1, 5])
def test_equal_rows_keep_a_text_of_their_own(spark, parts):
    rng = random.Random(8)
    alone = " ".join(str(rng.randint(0, 10**6)) for _ in range(60))
    shared = " ".join(str(rng.randint(0, 10**6)) for _ in range(40))
    inner = f"{shared} between {shared}"
    edge = f"{alone[:150]} edge {shared[:170]}"
    rows = [(1, alone), (2, inner), (3, edge)]
    df = spark.createDataFrame([r for r in rows for _ in range(3)], "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digest(df).collect())
    assert got == sorted((i, *x) for i, x in brute(rows).items() for _ in range(3))
    assert [r[2] for r in got[:3]] == [0, 0, 0]


def test_once_over_batches():
    none, some = np.zeros(0, np.int64), np.array([1, 1, 2])
    assert [len(c) for c in S._once(none, none, last=(1, 1))] == [0, 0]
    assert [c.tolist() for c in S._once(some, some, last=(1, 1))] == [[2], [2]]
    assert [c.tolist() for c in S._once(some, some)] == [[1, 2], [1, 2]]


def test_very_long_text(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    plain = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    long = plain(120_000) + passage + plain(60_000) + passage[50:350] + plain(20_000)
    rows = [(1, "x " + passage + " y"), (2, long), (3, long[:1000] + "!")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digest(df).collect()}
    assert got == brute(rows) and got[2][1] >= 700
