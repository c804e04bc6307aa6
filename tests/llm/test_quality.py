import random
import re
from collections import Counter

from lamina.llm.queries import quality_counts
from lamina.llm.quality import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(grams)
    cover = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), failed


def texts():
    rng = random.Random(3)
    yield from [None, "", " \n\t ", "one", "a b c d e f g h", "a " * 100, "x\n" * 50, "é日本 " * 30, "\r\nline\r\n\nline\r\n" * 9, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 0"]
    for _ in range(150):
        k = rng.choice([2, 5, 50, 5000])
        yield "".join(f"w{rng.randint(0, k)}{rng.choice(['', '#', '|', '.'])}" + rng.choice([" ", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(1, 200)))
    yield " ".join(f"w{i % 3000}" for i in range(20_000))


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_counts(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)
    assert quality(df.limit(0)).count() == 0


def test_verdict(spark):
    prose = "The baker walked to the harbour and bought salt.\nHer brother mended nets all winter long.\nNobody had seen such a calm sea, he said.\nThey sailed at noon with bread, ropes and two lamps."
    menu = "\n".join(f"Home {i} | About {i} | News {i} | Contact {i} | Jobs {i} | Press {i}" for i in range(9))
    noise = " ".join(f"word{i}### other{i}%%%" for i in range(60))
    shout = "\n".join(f"BUY NOW AND SAVE {i}!! ONLY TODAY AND NEVER AGAIN!!" for i in range(9))
    cases = {0: (prose, True), 1: (menu, False), 2: (noise, False), 3: (shout, False), 4: (prose + "\nLicensed under CC BY 4.0.", True), 5: (f"{prose}\nHome | News | Jobs | Press", True)}
    got = {r.doc_id: r for r in quality(spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")).collect()}
    for i, (_, kept) in cases.items():
        assert got[i].kept is kept, i
    assert got[4].clean_text == got[5].clean_text == prose
