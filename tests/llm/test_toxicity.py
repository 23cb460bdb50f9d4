from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity

from .conftest import DOCS, prose

BAD = ["zorgling", "vrekhead", "snarkwit", "grumbus", "dweezle"]


def corpus(n: int = 700) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = prose(i, 40)
        if toxic:
            text += " you " + " ".join(rng.choice(BAD) for _ in range(rng.randint(1, 3)))
        docs.append((i, text, "en", "web", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, DOCS)
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return df, dict((i, t) for i, _, t in labels), toxicity.train(df.where(~toxicity.held_out()), own.where(~toxicity.held_out()))


def test_held_out_rows_are_told_apart(trained):
    df, toxic, model = trained
    rows = toxicity.score_toxicity(df.where(toxicity.held_out()), model).collect()
    assert len(rows) > 150
    hits = [(r.score >= toxicity.THRESHOLD) == bool(toxic[r.doc_id]) for r in rows]
    assert np.mean(hits) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_whole_texts_are_read(trained):
    # A vocabulary of its own: random words without end have every n-gram.
    clean = " ".join([prose(9999, 60)] * 500)
    before, after = trained[2].scorer()([clean, clean + " " + " ".join(BAD)])
    assert before < 0.5 < after


def test_hits_far_apart_do_not_add_up():
    model, filler = toxicity.Model({"zor": 3.0, "vre": 3.0}, -4.0), "mild " * 100_000
    near, far, late = model.scorer()(["zor vre", f"zor {filler} vre", f"{filler} zor {'mild ' * 100} vre"])
    assert far < 0.5 < min(near, late)


def test_long_rows_are_training_rows(spark):
    docs = [(1, "x" * 300_000, "en", "web", 0), (2, "short", "en", "web", 0)]
    own = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.training_sample(spark.createDataFrame(docs, DOCS), own).count() == 2


def brute_windows(text: str | None) -> tuple[list[str], int]:
    padded = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
    half = toxicity.WINDOW_CHARS // 2
    return [padded[max(0, at - 8) : at + 2 * half] for at in range(0, max(1, len(padded) - half), half)], half


def brute_score(model: toxicity.Model, text: str | None) -> float:
    """The best window's sum over the distinct features whose last character lies in it."""
    (windows, half), sums = brute_windows(text), []
    for k, window in enumerate(windows):
        own = min(8, k * half) if k else 0
        ends = lambda g: [m.start() + len(g) - 1 for m in re.finditer(f"(?={re.escape(g)})", window)]  # noqa: B023, E731
        sums.append(sum(w for g, w in model.weights.items() if any(e >= own for e in ends(g))))
    return 1 / (1 + math.exp(-max(-30, min(30, max(sums) + model.bias))))


def test_scores_equal_a_plain_sum(trained):
    df, _, model = trained
    texts = [r.text for r in df.limit(40).collect()] + [None, "", "!", " ".join(BAD), prose(77, 900), prose(78, 2000) + " ".join(BAD) + prose(79, 500), "é" * 4000]
    assert model.scorer()(texts) == pytest.approx([brute_score(model, t) for t in texts], abs=1e-9)


def brute_ratios(rows: list[tuple[str, int]]) -> dict[str, float]:
    counts, sizes = (Counter(), Counter()), Counter(y for _, y in rows)
    for text, y in rows:
        words = {f" {w} " for w in re.findall(r"[^\W\d_]+", text.lower())}
        counts[y].update({w[i : i + n] for w in words for n in range(3, 9) for i in range(len(w) - n + 1)})
    found = {}
    for g in counts[0].keys() | counts[1].keys():
        p, q = counts[1][g] + 1, counts[0][g] + 1
        r = math.log(p / (sizes[1] + 2)) - math.log(q / (sizes[0] + 2))
        if p + q - 2 >= toxicity.MIN_DOCS and abs(r) / math.sqrt(1 / p + 1 / q) >= toxicity.MIN_Z:
            found[g] = r
    return found


def test_training_equals_a_plain_one(spark, trained):
    """The features and ratios by counting, and weights where the slope of the penalised loss is nearly flat."""
    docs, labels = corpus()
    toxic = {i: t for i, _, t in labels}
    rows = [(t, toxic[i]) for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    want, model = brute_ratios(rows), trained[2]
    assert set(model.weights) == set(want)
    grams = sorted(want)
    x = np.array([[want[g] * (g in " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " ") for g in grams] for t, _ in rows])
    y, w = np.array([t for _, t in rows]), np.array([model.weights[g] / want[g] for g in grams])
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + model.bias))) - y) / len(y) + toxicity.PENALTY * w
    assert abs(slope).max() < 2e-3


def test_counts_that_are_passed_on_early_add_up(spark, monkeypatch):
    docs, labels = corpus(80)
    sample = spark.createDataFrame([(t, labels[i][2]) for i, t, *_ in docs], "text string, toxic int")
    ratios = lambda: {r.gram: r.r for r in toxicity.gram_ratios(sample, 20, 60).collect()}
    whole = ratios()
    monkeypatch.setattr(toxicity, "HELD_GRAMS", 50)
    assert ratios() == pytest.approx(whole) and whole


def test_features_are_scaled_by_log_count_ratios(spark):
    rows = [("zorg", 1)] * 60 + [("mild", 0)] * 120
    got = {r.gram: r.r for r in toxicity.gram_ratios(spark.createDataFrame(rows, "text string, toxic int"), 60, 120).collect()}
    assert got["zorg"] == pytest.approx(np.log(61 / 62) - np.log(1 / 122))
    assert got["mild"] == pytest.approx(np.log(1 / 62) - np.log(121 / 122))


def test_scores_do_not_depend_on_other_columns(trained):
    df, _, model = trained
    changed = df.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    assert toxicity.score_toxicity(df, model).exceptAll(toxicity.score_toxicity(changed, model)).count() == 0


def test_messy_rows_and_empty_tables(messy, no_docs, labels, trained):
    rows = toxicity.score_toxicity(messy, trained[2]).collect()
    assert len(rows) == messy.count()
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    assert toxicity.score_toxicity(no_docs, trained[2]).count() == 0
    assert toxicity.train(no_docs, labels).weights == {}
    none = toxicity.train(messy, labels.where("toxic is null"))
    assert none.weights == {} and {r.score for r in toxicity.score_toxicity(messy, none).collect()} == {0.0}
    assert 0 <= toxicity.score_toxicity(messy, toxicity.train(messy, labels)).agg(F.max("score")).first()[0] <= 1


def test_repeated_training_rows_take_one_place_each(spark, monkeypatch):
    """One id on most rows is one row of the sample, and labels other than 0 and 1 are none."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 20)
    docs = spark.createDataFrame([(1, f"copy {i % 3}") for i in range(3000)] + [(i, f"text {i}") for i in range(2, 60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(2, 7), (3, 0)] + [(50, 2), (None, 1)], "doc_id long, toxic int")
    rows = [tuple(r) for r in toxicity.training_sample(docs, labels).collect()]
    assert len(rows) == len(set(rows)) == 20 and {t for _, t in rows} == {0, 1}
    assert sum(text.startswith("copy") for text, _ in rows) <= 1 and "text 3" not in {text for text, _ in rows}
