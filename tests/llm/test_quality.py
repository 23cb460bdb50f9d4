from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality

from .conftest import DOCS, messy_rows, prose


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_dup = len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), n_dup, len(covered)


def test_counts_equal_a_plain_count(spark):
    rng = random.Random(3)
    texts = [r[1] for r in messy_rows()] + [" ".join(rng.choice("ab#<c") for _ in range(n)) + "\nx\nx\n\n x" for n in (0, 2, 3, 4, 60)]
    rows = [(i, t, "en", "web", 0) for i, t in enumerate(texts)]
    got = quality.base_features(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 50, 0.0125), (3, 1000, 0.0125), (10, 2000, 0.0125), (20, 40, 0.3), (40, 40, 0.3), (0, 0, 0.1), (4880, 100_000, 0.05), (49_000, 1_000_000, 0.05)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, p in cases:
        got = df.where((F.col("k") == k) & (F.col("n") == n)).select(quality.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        want = math.fsum(math.exp(log(i)) for i in range(k + 1)) if k < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-9 if n < 10_000 else 1e-7)


def test_cutoffs_are_certified_per_stratum(spark):
    """Good documents of one language are full of symbols; the rule must abstain there and act elsewhere."""
    rows, labels = [], []
    for i in range(420):  # 105 good rows a language: fewer than 72 certify nothing
        lang, good = ("xx", "yy")[i % 2], (i // 2) % 2 == 0
        noisy = not good or lang == "yy"
        rows.append((i, prose(i, 60) + (" ###########" * 10 if noisy else ""), lang, "web", 0))
        labels.append((i, int(good), 0))
    out = quality.quality_rules(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {(r.stratum, r.doc_id // 2 % 2 == 0): r.share for r in out.groupBy("stratum", "doc_id").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept["xx", True] == 1 and kept["xx", False] == 0
    assert kept["yy", True] == 1 and kept["yy", False] == 1


def brute_policies(rows: list[tuple], labels: dict[int, int]) -> dict:
    """stratum -> the step that is taken, by a plain walk along the path."""
    score = {
        "symbol": lambda t: brute(t)[2] / max(1, brute(t)[1]),
        "dup_line": lambda t: brute(t)[3] / max(1, len([x for x in t.split("\n") if x.strip()])),
        "repeat": lambda t: brute(t)[4] / max(1, brute(t)[0]),
        "mark": lambda t: len(re.findall("[!?]", t)) / max(1, brute(t)[0]),
    }
    strata, taken = {r[2] for r in rows if r[0] in labels}, {}
    for stratum in strata:
        own = {r[0]: r[1] for r in rows if r[2] == stratum and r[0] in labels}
        good, bad = [t for i, t in own.items() if labels[i]], [t for i, t in own.items() if not labels[i]]
        best = 0.0
        for step in range(len(quality.PATH)):
            rejects = lambda t: any(score[rule](t) > cut for rule, cut in quality.PATH[: step + 1])  # noqa: B023, E731
            k, n = sum(map(rejects, good)), len(good)
            tail = sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) if k < 0.05 * n else 1.0
            if tail > 0.05 / len(strata):
                break
            gain = sum(map(rejects, bad)) / max(1, len(bad)) - 10 * k / max(1, n)
            if gain > best + 1e-12:
                best, taken[stratum] = gain, step
    return taken


def test_policies_equal_a_plain_walk(spark):
    """Strata with many and few labels, a null and an empty one, repeated rows, contradicting labels."""
    rng, rows, labels = random.Random(12), [], []
    for i in range(900):
        good = rng.random() < 0.6
        text = prose(i, 55)
        if rng.random() < (0.02 if good else 0.6):
            text += rng.choice([" ####" * rng.randint(1, 30), " wow!?" * rng.randint(1, 40), "\nsame line here" * rng.randint(2, 9)])
        rows.append((i, text, ("a", "a", "a", "b", "", None)[i % 6], "web", 0))
        labels.append((i, int(good), 0))
    doubled = rows + [r for r in rows if r[0] % 3 == 0]
    unsure = [(i, 1 - q, 0) for i, q, _ in labels if i % 17 == 0]
    out = quality.quality_rules(spark.createDataFrame(doubled, DOCS), spark.createDataFrame(labels + unsure, "doc_id long, quality int, toxic int"))
    got = {r.stratum: r.policy for r in out.select("stratum", "policy").distinct().collect()}
    want = brute_policies(rows, {i: q for i, q, _ in labels if i % 17})
    assert {k: v for k, v in got.items() if v is not None} == want and {"a", None} <= set(want) | {"a", None} and "a" in want
    assert set(got) == {"a", "b", "", None}


def test_equal_gains_take_the_mildest_step(spark):
    rows = [(i, prose(i, 60) + ("" if i < 200 else " ####" * 40), "en", "web", 0) for i in range(240)]
    labels = [(i, int(i < 200), 0) for i in range(240)]
    out = quality.quality_rules(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.policy for r in out.select("policy").distinct().collect()} == {0}


def test_no_rule_acts_without_labels(spark, messy):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(messy, none).where("kept = base_failed").count() == 0


def test_messy_rows_and_empty_tables(messy, no_docs, labels):
    assert quality.quality_rules(messy, labels).count() == messy.count()
    assert quality.quality_rules(no_docs, labels).count() == 0
    kept = quality.keep_good(messy, labels)
    assert kept.columns == messy.columns
    assert {r.doc_id for r in kept.collect()} <= {None, 4, 5, 6, 8}
    assert quality.keep_good(no_docs, labels).count() == 0
