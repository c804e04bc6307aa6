import random
import re

import numpy as np
import pytest

from lamina.llm import jaccard as J
from lamina.llm.components import components
from lamina.llm.jaccard import jaccard_components


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def union_find(ids, links):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(rng, n=160):
    docs = []
    passage = [f"p{i}" for i in range(60)]
    for i in range(n):
        size = rng.choice([1, 3, 5, 8, 14, 25, 40, 70, 150, 400])
        words = [f"w{rng.randint(0, 3000)}" for _ in range(size)]
        if rng.random() < 0.3:
            words[size // 2 : size // 2] = passage
        docs.append(words)
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(words)
            for _ in range(rng.choice([0, 1, 1, max(1, size // 40), max(1, size // 20)])):
                k = rng.randrange(len(near))
                near[k : k + rng.choice([0, 1])] = [f"x{rng.randint(0, 50)}"] * rng.choice([0, 1])
                near = near or ["z"]
            docs.append(near)
    rng.shuffle(docs)
    return [(i, rng.choice([" ", "\n", "  "]).join(w)) for i, w in enumerate(docs)]


def check(spark, rows):
    sets = {i: brute_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(sets, links)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(random.Random(seed))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "Ünï A b"), (9005, "Ünï a B"), (9006, "ünï a b")]
    check(spark, rows)


def test_signatures_miss_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in [2, 5, 9, 10, 12, 20, 31, 32, 33, 40, 64, 100, 333, 1000, 4000]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            y = int(rng.integers(max(1, -(-4 * n // 5)), n + 1))
            # The pair with as many differences as a link allows.
            common = -(-4 * (n + y) // 9)
            if common > y:
                continue
            b = np.unique(np.concatenate([rng.permutation(a)[:common], rng.integers(0, 2**64, y - common, dtype=np.uint64)]))
            if len(b) != y or np.array_equal(a, b):
                continue
            assert set(J.signatures(a).tolist()) & set(J.signatures(b).tolist())
            assert np.bitwise_count(J._fold(J.parity(a), min(len(J.parity(a)), len(J.parity(b)))) ^ J._fold(J.parity(b), min(len(J.parity(a)), len(J.parity(b))))).sum() <= n + y - 2 * common


@pytest.mark.parametrize("held", [4_000_000, 5])
def test_shared_rows(monkeypatch, held):
    import pyarrow as pa

    monkeypatch.setattr(J, "_HELD", held)
    rng = random.Random(0)
    sets = {n: {rng.randint(0, 200) for _ in range(30)} for n in range(40)}
    spread = lambda s: (s * 0x9E3779B97F4A7C15) % 2**64
    monkeypatch.setattr(J, "signatures", lambda h: h)
    packed = []
    for part in range(4):
        signed = J._Signed(3)
        for n in range(part, 40, 4):
            packed += signed.add(n, np.array([spread(s) for s in sets[n]], np.uint64))
        packed += signed.out()
    table = pa.Table.from_batches(packed).sort_by("bucket")
    got = [tuple(x) for b in J._shared(iter(table.to_batches(max_chunksize=3))) for x in zip(*(c.to_pylist() for c in b.columns))]
    holders = {}
    for n, s in sets.items():
        for x in s:
            holders.setdefault(int(np.array(spread(x), np.uint64).view(np.int64)), set()).add(n)
    want = {(s, n) for s, ns in holders.items() if len(ns) > 1 for n in ns}
    assert {x[:2] for x in got} == want and all(x[3] == 0 for x in got)
    # The leads of a signature make one tree of its nodes.
    for s, ns in holders.items():
        if len(ns) > 1:
            assert len(set(union_find(ns, [x[1:3] for x in got if x[0] == s]).values())) == 1


def test_groups_over_batches():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [np.unique(np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate([texts[i % 4][rng.randint(0, 8) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, 9))], np.uint64)])) for i in range(40)]
    rows = sorted((rng.randint(0, 12), n, rng.randint(0, 3), rng.randint(0, 1)) for n in range(40) for _ in range(3))
    want = set()
    for key, a, ca, sa in rows:
        for other, b, cb, sb in rows:
            sides = {s for k, _, _, s in rows if k == key}
            if key == other and a > b and ca != cb and (len(sides) == 1 or sa != sb) and len(np.intersect1d(sets[a], sets[b])) >= J.least_common(len(sets[a]) + len(sets[b])):
                want.add((a, b))
    columns = [*(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1, 2)), pa.array([r[3] for r in rows], pa.int32()), pa.array([len(sets[r[1]]) for r in rows], pa.int64()), pa.array([J.parity(sets[r[1]]).tobytes() for r in rows], pa.binary())]
    table = pa.Table.from_arrays(columns, ["key", "node", "component", "side", "n", "parity"])
    for size in (1, 2, 7, 200):
        got = {x for b in J._close(iter(table.to_batches(max_chunksize=size))) for x in zip(*(c.to_pylist() for c in b.columns))}
        assert want <= got and want
        for a, b in got - want:
            assert 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (3, "q r s"), (3, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, None), (7, 2, 5), (3, 1, 3), (3, 3, 3)], key=str)
    rows = [(1, "q r s"), (4, "q r s"), (4, "x y z"), (6, "x y z"), (None, "u v"), (None, "u v")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, 1), (4, 1, 1), (4, 1, 1), (6, 1, 1), (None, 1, None), (None, 1, None)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (60, 61), (61, 60), (80, 80), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 60: 60, 61: 60}
