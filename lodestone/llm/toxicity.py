"""Operator 10: toxicity by a linear classifier over character n-grams.

Features are the distinct n-grams of ``GRAMS`` lengths of a text's lower-cased
words, each word with a space on both sides.  A feature's value is its naive
Bayes log-count ratio ``r = log(p / |p|) - log(q / |q|)`` over the toxic and the
other training rows (document frequencies, plus one); on these values a logistic
regression with a quadratic penalty is fitted.  Only features that ``MIN_DOCS``
rows have and whose ``r`` is ``MIN_Z`` standard errors from zero take part: the mass
of rare n-grams of long texts would drown the rest.

A text is scored by windows of ``WINDOW_CHARS`` characters, each half over the
one before, and its score is the highest: chance hits add up over a window only,
not over a long text.

The classifier is fitted on a bounded sample, the ``SAMPLE_ROWS`` labelled ids
that come first by hash, with one row of any length each (of rows with one id the
first by hash of the text); of each the window with the
highest sum of ratios is the training row.  Counts and features of the sample are
made by Spark tasks, and the driver fits a few thousand weights.  Every score
reads the whole text, in one pass of an Aho-Corasick automaton over the features.

Defined results: null and empty texts get the score of no features; labels other
than 0 and 1 count as none, and those that contradict each other for one id teach nothing; with fewer than two
classes to learn from every score is the share of toxic rows (0 without rows);
repeated rows score alike; an empty table gives an empty result.  Only
``doc_id`` and ``text`` are read; ids pick training rows and are no feature.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import doc_bucket, materialize

GRAMS = (3, 4, 5, 6, 7, 8)
SAMPLE_ROWS = 10_000
WINDOW_CHARS = 1500
MIN_Z = 3.0
MIN_DOCS = 4
#: Counts that a task holds before it passes them on.
HELD_GRAMS = 300_000
PENALTY = 1e-4
STEPS = 300
STEP_SIZE = 0.05
THRESHOLD = 0.7
FOLDS = 3
HELD_OUT = 1

_NO_LETTERS = re.compile(r"[\W\d_]+")


def normalized(text: str | None) -> str:
    """Lower-cased words with single spaces between and around them."""
    return f" {_NO_LETTERS.sub(' ', (text or '').lower()).strip()} "


def grams_of(text: str | None) -> set[str]:
    padded = [f" {w} " for w in set(normalized(text).split())]
    return {w[i : i + n] for w in padded for n in GRAMS for i in range(len(w) - n + 1)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: The score of every text, where there was nothing to tell apart.
    constant: float | None = None

    def scorer(self) -> Callable[[list[str | None]], list[float]]:
        """A function that scores texts, with the automaton built once."""
        finder, values = _finder(list(self.weights)), list(self.weights.values())

        def score(texts: list[str | None]) -> list[float]:
            if self.constant is not None:
                return [self.constant] * len(texts)
            sums = [max(sum(values[i] for i in window) for window in _windows(finder, text)) + self.bias for text in texts]
            return _sigmoid(np.array(sums)).tolist()

        return score


def _finder(grams: list[str]):
    finder = ahocorasick.Automaton()
    for i, gram in enumerate(grams):
        finder.add_word(gram, i)
    if grams:
        finder.make_automaton()
    return finder


def _windows(finder, text: str | None) -> list[list[int]]:
    """Numbers of the distinct n-grams of each window of a text, in order; one window at least."""
    if not len(finder):
        return [[]]
    padded, step = normalized(text), WINDOW_CHARS // 2
    # An n-gram lies where its last character is; a window is two blocks.
    blocks: list[set[int]] = [set() for _ in range(max(2, -(-len(padded) // step)))]
    for end, i in finder.iter(padded):
        blocks[end // step].add(i)
    return [sorted(a | b) for a, b in pairwise(blocks)]


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded sample; contradicting labels are left out."""
    agreed = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("hi")).where("toxic = hi")
    # The ids of the sample come first, so that only its texts are joined.
    labelled = docs.select("doc_id").join(agreed, "doc_id").select("doc_id", "toxic").distinct()
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(materialize(chosen, "toxicity-ids")), "doc_id")
    # One row an id, however many share it.
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def gram_ratios(sample: DataFrame, n_toxic: int, n_other: int) -> DataFrame:
    """(gram, r) of the features."""

    def rows(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        grams = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(grams), 100_000):
            part = grams[at : at + 100_000]
            columns = [pa.array(part, pa.string()), *(pa.array([counts[c][g] for g in part], pa.int64()) for c in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "p", "q"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                counts[toxic.as_py()].update(grams_of(text.as_py()))
                if sum(map(len, counts)) > HELD_GRAMS:
                    yield from rows(counts)
                    counts = (Counter(), Counter())
        yield from rows(counts)

    counted = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "gram string, p long, q long")
    total = counted.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= MIN_DOCS)
    p, q = F.col("p") + 1, F.col("q") + 1
    rated = total.withColumn("r", F.log(p / (n_toxic + 2)) - F.log(q / (n_other + 2))).withColumn("z", F.abs("r") / F.sqrt(1 / p + 1 / q))
    return rated.where(F.col("z") >= MIN_Z).select("gram", "r")


def fit_weights(found: pa.ListArray, toxic: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression over rows of feature numbers, each with its ratio as value (Adam, full batch)."""
    n = len(found)
    index = found.flatten().to_numpy()
    owner = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(found).to_numpy())
    values = ratios[index]
    w = np.zeros(len(ratios) + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(toxic.mean() / (1 - toxic.mean()))
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, values * w[index], n) + w[-1]
        error = (_sigmoid(z) - toxic) / n
        slope = np.append(np.bincount(index, values * error[owner], len(ratios)) + PENALTY * w[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= STEP_SIZE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1] * ratios, float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Both tables hold training rows only."""
    sample = materialize(training_sample(docs, labels).repartition(16), "toxicity-sample")
    sizes = dict(sample.groupBy("toxic").count().collect())
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return Model({}, 0.0, constant=1.0 if n_toxic else 0.0)
    # In order of the gram, so that sums of floats are the same on every run.
    features = sorted((r.gram, r.r) for r in gram_ratios(sample, n_toxic, n_other).collect())
    grams, ratios = [g for g, _ in features], np.array([r for _, r in features])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(grams)
        for batch in batches:
            found = [max(_windows(finder, text.as_py()), key=lambda window: sum(ratios[i] for i in window)) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["k", "found", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("k")).mapInArrow(find, "k long, found array<int>, toxic int").toArrow()
    # In an order of their own, so that sums of floats are the same on every run.
    rows = rows.sort_by([("k", "ascending"), ("toxic", "ascending")])
    weights, bias = fit_weights(rows.column("found").combine_chunks(), rows.column("toxic").to_numpy().astype(float), ratios)
    return Model(dict(zip(grams, weights.tolist(), strict=True)), bias)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out():
    return doc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT
