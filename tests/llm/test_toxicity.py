import random
import zlib

import numpy as np

from lamina.llm.queries import op10_toxicity, toxicity_digest
from lamina.llm.toxicity import fit_toxicity, place, score_toxicity

WORDS = [a + b for a in ("ba", "no", "ti", "re", "mo") for b in ("lan", "must", "sok", "vera")]


def labelled(rng, n, identity=0.0, slurs=1.0):
    """Toxic rows have a slur, in the given share; identity terms stand in toxic rows in the given share."""
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 40))]
        if toxic and rng.random() < slurs:
            words.insert(rng.randrange(len(words)), rng.choice(["Slurone", "SLURTWO!", "slurthree,"]))
        if rng.random() < (identity if toxic else 0.02):
            words.insert(rng.randrange(len(words)), rng.choice(["Muslim", "christian", "Jewish"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(random.Random(1), 1500)
    docs += [(9001, None), (9002, ""), (9002, "")]
    d, lab = frames(spark, docs, labels)
    truth = {i: t for i, _, t in labels}
    rows = toxicity_digest(d, lab).collect()
    assert len(rows) == len(docs) and toxicity_digest(d, lab).dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in rows if r.doc_id > 9000}) == 1


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(random.Random(2), 600)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (fit_toxicity(*frames(spark, docs, x)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.intercept == b.intercept


def test_counterfactuals_lower_neutral_mentions(spark):
    docs, labels = labelled(random.Random(3), 2500, identity=0.5, slurs=0.6)
    d, lab = frames(spark, docs, labels)
    with_, without = fit_toxicity(d, lab), fit_toxicity(d, lab, counterfactual=0.0)
    text = ["nolan a muslim verasok balan", "nolan a people verasok balan", "nolan slurone balan"]
    fair, plain = with_.scores(text), without.scores(text)
    assert fair[0] < plain[0] - 0.2 and abs(fair[0] - fair[1]) < 0.15 and fair[2] > 0.5
    assert with_.weights[place("muslim")] < 0.3 * without.weights[place("muslim")]


def test_no_labels_and_empty_tables(spark):
    docs, labels = labelled(random.Random(4), 20)
    d, lab = frames(spark, docs, labels)
    assert {r.predicted for r in score_toxicity(d, fit_toxicity(d, lab.limit(0))).collect()} == {0}
    assert score_toxicity(d.limit(0), fit_toxicity(d.limit(0), lab)).count() == 0
    nulls = spark.createDataFrame([(1, 1, None), (None, 1, 1)], lab.schema)
    assert fit_toxicity(d, nulls).weights.any() == np.False_


def test_query_on_tables(spark):
    """On the small tables the held-out rows are told apart well."""
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.9
