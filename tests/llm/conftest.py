"""Tables that every operator has to take."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use within.
CLASHING = ("row", "stratum", "kept", "fp", "size", "th", "idx", "key", "h", "w", "words", "lines", "runs", "chunks", "target", "block", "own_id", "component_id", "meta.url", "row.text", "back`tick", "two words")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(max(20, n // 3))]
    return " ".join(rng.choice(words) for _ in range(n))


def messy_rows() -> list[tuple]:
    long_text = "\n".join(prose(1000 + i, 60) for i in range(300))
    rows = [
        (1, None, "en", "web", 0),
        (2, "", "en", "web", 0),
        (3, " \t\n\x0b ", None, None, 4),
        (None, prose(1, 80), "de", "web", 1),
        (4, prose(2, 80), None, "books", 1),
        (5, prose(2, 80), "en", None, 1),
        (6, prose(3, 80), "en", "web", 1),
        (6, prose(3, 80), "en", "web", 1),
        (7, "café \U0001f600 中文 İstanbul Σ", "fr", "web", None),
        (8, long_text, "en", "books", len(long_text)),
        (9, "one", "en", "web", 3),
        (10, "x" * 50_000, "en", "web", 50_000),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows(), DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 8)] + [(1, 0, 1), (None, 1, 1), (8, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
