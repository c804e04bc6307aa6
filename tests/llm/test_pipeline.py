import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as leaking
from tests.llm.test_jaccard import brute_set, union_find
from tests.llm.test_secrets import base


def tables(spark, folder):
    rng = random.Random(11)
    words = [a + b for a in ("ba", "no", "ti", "re", "mo", "sa") for b in ("lan", "must", "sok", "vera", "pik", "dun")]
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            text.insert(3, rng.choice(["slurone", "slurtwo"]))
        labels.append((i, 1, toxic))
        docs.append([i, " ".join(text)])
    benchmark = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(5)]
    docs[1][1] += " " + benchmark[2][1]
    docs[5][1] = docs[2][1]
    docs[6][1] = docs[2][1] + " extra"
    docs[7][1] += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    docs += [[900, None], [901, ""], [902, "<|endoftext|> é"], [902, "<|endoftext|> é"], [None, "no id here"]]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, dict((i, t) for i, _, t in labels), benchmark


def test_every_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, toxic, benchmark = tables(spark, folder)
    read = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    by_name = dict(P.STAGES)

    now = by_name["toxicity"](spark, now, folder)
    assert now.columns == P.COLUMNS
    want = sorted(((i, t) for i, t in docs if not toxic.get(i)), key=str)
    assert read(now) == want

    now = by_name["near_duplicates"](spark, now, folder)
    sets = {i: brute_set(t) for i, t in want if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    best = union_find(sets, links)
    want = sorted({(i, t) for i, t in want if i is None or best[i] == i}, key=str)
    assert read(now) == want and now.columns == P.COLUMNS and 5 not in {i for i, _ in want}

    now = by_name["decontamination"](spark, now, folder)
    bad = {d for d, _ in leaking([(i, t) for i, t in want if i is not None], benchmark)}
    want = [(i, t) for i, t in want if i not in bad]
    assert bad == {1} and read(now) == sorted(want, key=str)

    now = by_name["secrets"](spark, now, folder)
    got = {r.doc_id: r for r in now.collect()}
    for i, t in want:
        assert (got[i].text == t and got[i].n_chars == (None if t is None else len(t))) if not base(t or "") else "[REDACTED]" in got[i].text and got[i].n_chars == len(got[i].text)
    want = [(i, got[i].text) for i, _ in want]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in by_name["bpe"](spark, now, folder).collect()}
    assert out == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in want}
    assert sorted(map(str, (r.doc_id for r in P.run(spark, folder).collect()))) == sorted(str(i) for i, _ in want)
    assert re.match("op|pipeline", "pipeline") and P.ORACLE_SQL is None
