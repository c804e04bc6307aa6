import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamina.llm import lm as L
from lamina.llm.common import mix64
from lamina.llm.queries import lm_scores


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [("end",)]


class Brute:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.pairs.update(zip([("start",), *w], w))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = L.discounts([sum(x == k for x in self.pairs.values()) for k in (1, 2, 3, 4)])
        self.before, self.total, self.kinds = Counter(), Counter(), defaultdict(Counter)
        for (a, b), x in self.pairs.items():
            self.before[b] += 1
            self.total[a] += x
            self.kinds[a][min(x, 3)] += 1
        self.e = L.discounts([sum(x == k for x in self.before.values()) for k in (1, 2, 3, 4)])
        many = Counter(min(x, 3) for x in self.before.values())
        self.all = len(self.pairs)
        self.mass = sum(self.e[k - 1] * many[k] for k in (1, 2, 3)) / self.all if self.all else 1.0

    def p(self, a, b):
        low = max(0, self.before[b] - (self.e[min(self.before[b], 3) - 1] if self.before[b] else 0)) / max(1, self.all) + self.mass / (self.v + 1)
        if not self.total[a]:
            return low
        x = self.pairs[a, b]
        return max(0, x - (self.d[min(x, 3) - 1] if x else 0)) / self.total[a] + sum(self.d[k - 1] * self.kinds[a][k] for k in (1, 2, 3)) / self.total[a] * low

    def row(self, text):
        w = tokens(text)
        base = sum(math.log10((self.c[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(a, b)) for a, b in zip([("start",), *w], w))


def corpus():
    rng = random.Random(6)
    words = [f"w{i}é" for i in range(60)] + ["The", "the", "THE", "x" * 40]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 20, 64])]) for _ in range(rng.randint(0, 60)))) for i in range(250)]
    return docs + [(900, None), (901, ""), (902, " \n"), (903, "never seen words"), (904, "a " * 5000), (904, "a b"), (None, "the x"), (905, "</s> <s>")]


@pytest.mark.parametrize("kept", [2_000_000, 50])
def test_against_brute_force(spark, monkeypatch, kept):
    monkeypatch.setattr(L, "_KEPT", kept)
    docs = corpus()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    model = Brute([t for i, t in docs if not held(i)])
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    got = sorted((tuple(r) for r in lm_scores(df).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(((i, held(i), *model.row(t)) for i, t in docs), key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_probabilities_sum_to_one():
    model = Brute([t for _, t in corpus()])
    for a in (("start",), "the", "w3é", "unknown"):
        assert sum(model.p(a, b) for b in model.c) + model.p(a, "unseen") == pytest.approx(1.0, abs=1e-9)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm_scores(df.limit(0)).count() == 0


def test_unmix():
    x = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    assert np.array_equal(L.unmix64(mix64(x)), x)


def test_long_texts_and_clashing_names(spark):
    long = "some words of a text " * 60_000
    docs = [(1, long), (2, "some words"), (3, "x" * 1_000_000), (4, None)]
    model = Brute([t for i, t in docs if zlib.crc32(str(i).encode()) % 10])
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity", "held_out")
    df = spark.createDataFrame([(i, t, *range(7)) for i, t in docs], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for r in lm_scores(df).collect():
        want = model.row(dict(docs)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)


def test_few_mapped_files(spark, monkeypatch):
    """Files that are mapped anew whenever they are needed give the same."""
    monkeypatch.setattr(L, "_MAPPED", 0)
    docs = [(i, f"a b{i % 7} c{i % 3} a") for i in range(40)]
    model = Brute([t for i, t in docs if zlib.crc32(str(i).encode()) % 10])
    for r in lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.score == pytest.approx(model.row(dict(docs)[r.doc_id])[4], rel=1e-9)
