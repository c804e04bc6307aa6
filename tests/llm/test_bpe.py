import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm.bpe import LATER, Vocabulary, bpe_decode, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = Vocabulary(open(PATH, encoding="utf-8").read())


def same(text):
    ids = np.frombuffer(OURS.encode([text], {})[0], "<u4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert OURS.decode(np.asarray(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_as_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "aaaaaaa", "  two\n\n\nlines\t ", "it's WE'LL 'tis", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "é" * 50, "x" * 5000, "🤖 ok", "日本語 12³"])
def test_cases(text):
    same(text)


def test_every_later_code_point():
    for a, b in LATER:
        for c in {a, b}:
            same(f"é{chr(c)}1{chr(c)}! {chr(c)}")


def test_lower_ranks_that_come_up_go_first():
    """A vocabulary where one token has two merges: the library and the index agree."""
    from tokenizers import models

    vocab = {c: i for i, c in enumerate("abcd")} | {"ab": 4, "abc": 5, "bc": 6, "abcd": 7, "cd": 8}
    merges = [("b", "c"), ("abc", "d"), ("a", "bc"), ("a", "b"), ("ab", "c"), ("c", "d")]
    library = Tokenizer(models.BPE(vocab, merges))
    import json

    from lamina.llm.bpe import _byte_letters

    letters = list(_byte_letters())
    full = {"model": {"vocab": vocab | {c: 100 + i for i, c in enumerate(letters) if c not in vocab}, "merges": merges}}
    ours = Vocabulary(json.dumps(full))
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        assert ours.merge([word.encode()])[0] == library.encode(word).ids
    assert not ours.ordered and OURS.ordered


def test_both_ways_to_merge_agree():
    rng = random.Random(8)
    words = ["".join(rng.choice("aab hé\0t,e日") for _ in range(rng.randint(0, 30))).encode() for _ in range(500)]
    assert OURS.merge_all(words) == [np.asarray(x, "<u4").tobytes() for x in OURS.merge(words)]


def test_frame(spark):
    rows = [(1, "one two", "x"), (2, None, "y"), (3, "", "z"), (1, "one two", "x"), (None, "word " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe_encode(df, PATH, decode=True)
    got = sorted(((r.doc_id, r.n_tokens, r.decoded) for r in out.collect()), key=str)
    assert got == sorted(((i, len(LIBRARY.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in rows), key=str)
    assert sorted(r.decoded for r in bpe_decode(out, PATH).collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe_encode(df.limit(0), PATH).count() == 0
