"""A toxicity classifier that is fitted to labels and held to the same score when identity terms are swapped.

The model is a logistic regression on which words a text has. For each labelled text with an identity term, counterfactuals put each other term of the
group, or the group's neutral noun, in its place; the squared change of the score's logit is added to the loss, so a group's mention alone tells little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import crc_mod, lean, span_hashes, text_bytes

#: Bits of a word's place among the features, labelled rows that the fit takes at most (those with the smallest hash of their id), words that get a weight at most.
BITS, MAX_LABELLED, MAX_WORDS = 20, 12_000, 3_000
#: A word needs this many standard errors between the classes, in so many rows, to get a weight.
MIN_Z, MIN_ROWS = 4.5, 5
L2, COUNTERFACTUAL, STEPS = 0.5, 10.0, 400
#: Labels are learned from rows whose crc32 of the id modulo FOLDS is not 0.
FOLDS = 5

#: Groups of identity terms; the first of each is its neutral noun.
IDENTITIES = (
    ("people", "women", "men", "transgender"), ("person", "woman", "man"), ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("believer", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("citizens", "immigrants", "refugees", "foreigners", "natives"),
    ("human", "black", "white", "asian", "latino", "african", "european", "arab"), ("couple", "gay", "lesbian", "straight", "bisexual", "queer"), ("adult", "old", "young", "elderly"),
    ("patient", "disabled", "blind", "deaf"),
)

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[*range(48, 58), *range(97, 123)]] = True
_CHUNK = 2 << 20


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words, runs of letters and digits, and their places among the features."""
    edge = np.diff(np.concatenate([[False], _LETTER[data], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, (span_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)


def place(word: str) -> int:
    """A word's place among the features."""
    return int(_words(np.frombuffer(text_bytes(word), np.uint8))[1][0])


def _chunked(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in chunks: how many, and for each word its text within the chunk and its place."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at + len(parts) < len(texts) and (size < _CHUNK or not parts):
            parts.append(text_bytes(texts[at + len(parts)]))
            size += len(parts[-1]) + 1
        starts, places = _words(np.frombuffer(b" ".join(parts), np.uint8))
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        yield len(parts), np.searchsorted(begins, starts, side="right") - 1, places
        at += len(parts)


@dataclass
class ToxicityModel:
    """Weights by place among the features, and the logit of a text without any."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list) -> np.ndarray:
        """The score of each text, from 0 to 1."""
        out = []
        some = self.weights != 0
        for n, text, places in _chunked(texts):
            has = some[places]
            pairs = np.unique(text[has] << BITS | places[has])
            out.append(self.intercept + np.bincount(pairs >> BITS, weights=self.weights[pairs & ((1 << BITS) - 1)], minlength=n))
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for n, text, places in _chunked(batch.column(2).to_pylist()):
            pairs = np.unique(text << BITS | places)
            cuts = np.searchsorted(pairs >> BITS, np.arange(n + 1))
            found += [(pairs[a:b] & ((1 << BITS) - 1)).astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "toxic", "places"])


def fit_rows(toxic: np.ndarray, rows: list[np.ndarray], counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    """The model of rows of distinct places and their labels."""
    weights, n = np.zeros(1 << BITS), len(rows)
    positives = int(toxic.sum())
    prior = (positives + 0.5) / (n + 2)
    if not 0 < positives < n:
        return ToxicityModel(weights, math.log(prior / (1 - prior)))
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    of = np.repeat(np.arange(n), lengths)
    in_toxic = np.bincount(flat[toxic[of] == 1], minlength=1 << BITS)
    in_all = np.bincount(flat, minlength=1 << BITS)
    rate = positives / n
    z = (in_toxic - in_all * rate) / np.sqrt(np.maximum(in_all * rate * (1 - rate), 1e-9))
    chosen = np.flatnonzero((np.abs(z) >= MIN_Z) & (in_all >= MIN_ROWS))
    chosen = chosen[np.argsort(-np.abs(z[chosen]), kind="stable")][:MAX_WORDS]
    groups = [[place(w) for w in group] for group in IDENTITIES]
    # The neutral nouns have no weight: what a group's term has is held to nothing by each swap for its noun.
    neutral = [group[0] for group in groups]
    features = np.setdiff1d(np.union1d(chosen, [p for group in groups for p in group]), neutral)
    column = np.full(1 << BITS, -1)
    column[features] = np.arange(len(features))
    known = column[flat] >= 0
    row, col = of[known], column[flat[known]]
    # Each term that stands in a labelled row is swapped for each other one of its group: the logit changes by the difference of their weights.
    swaps = [(column[a], column[b], in_all[a]) for group in groups for a in group for b in group if a != b and in_all[a]]
    swaps = [(a, b if b >= 0 else len(features), c) for a, b, c in swaps if a >= 0]
    left, right, times = (np.array(x) for x in zip(*swaps)) if swaps else (np.zeros(0, int),) * 3
    w, b = np.zeros(len(features) + 1), math.log(prior / (1 - prior))  # the last place is that of the neutral nouns
    m_w, v_w = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        logit = b + np.bincount(row, weights=w[col], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - toxic
        grad = np.bincount(col, weights=error[row], minlength=len(w)) + L2 * w
        if len(left):
            pull = counterfactual * 2 * times * (w[left] - w[right])
            grad += np.bincount(left, weights=pull, minlength=len(w)) - np.bincount(right, weights=pull, minlength=len(w))
        grad[-1] = 0.0
        full = np.append(grad, error.sum())
        m_w, v_w = 0.9 * m_w + 0.1 * full, 0.99 * v_w + 0.01 * full * full
        move = 0.1 * min(1, 2 * (STEPS - step) / STEPS) * (m_w / (1 - 0.9**step)) / (np.sqrt(v_w / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights[features] = w[:-1]
    return ToxicityModel(weights, float(b))


def fit_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    """Fit the classifier to the labelled documents outside the held-out fold.

    The sample is bounded by max_labelled ids, and only sets of word places come to the driver, in all some tens of MB. Rows without a label or an id aren't used; of contradicting
    labels of an id the larger holds; an id counts once, of several texts that with the smallest hash of its places. With no labels, or one class alone, every score is near the share of that class."""
    named = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__toxic")).where("__toxic IS NOT NULL AND __id IS NOT NULL")
    named = named.where(crc_mod(F.col("__id"), FOLDS) != 0).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    sample = named.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    joined = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(sample), "__id")
    told = joined.select(F.xxhash64("__id").alias("id"), "__toxic", "__text").mapInArrow(lean(_features), "id long, toxic int, places binary")
    first = told.groupBy("id").agg(F.min(F.struct(F.xxhash64("places").alias("h"), "places", "toxic")).alias("r"))
    found = first.select("r.*").orderBy("h", "places", "toxic").select("toxic", "places").toArrow()
    rows = [np.frombuffer(x.as_py(), "<u4") for x in found.column("places")]
    return fit_rows(found.column("toxic").to_numpy().astype(np.int64), rows, counterfactual)


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, score double from 0 to 1 and predicted int (1 from 0.5 on) of every whole text.

    A null text counts as empty and has the score of a text without known words. Rows are worked on alone; other columns don't matter. The model's size is fixed."""
    spark, names = df.sparkSession, tuple(keep)
    at = np.flatnonzero(model.weights)
    shipped = spark.sparkContext.broadcast((at, model.weights[at], model.intercept))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, intercept = shipped.value
        weights = np.zeros(1 << BITS)
        weights[places] = values
        held = ToxicityModel(weights, intercept)
        for batch in batches:
            scores = held.scores(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return df.select(*names, F.col(text_col).cast("string").alias("__text")).mapInArrow(lean(work), schema)
