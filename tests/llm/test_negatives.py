"""Operator 12 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], modulus: int = 100, positives: int = 5, count: int = 5, least: int = 80) -> list[tuple]:
    """rows: distinct (id, label, x)."""
    out = []
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    for a in rows:
        if a[0] % modulus:
            continue
        others = sorted(((-score(a[2], b[2]), b[0], b) for b in rows if b is not a), key=lambda t: t[:2])
        near = [(-s, i) for s, i, b in others if b[1] == a[1]][:positives]
        for s, i in near:
            fits = [(-n, j) for n, j, b in others if b[1] != a[1] and least * s <= 100 * -n <= 100 * s][:count]
            out += [(a[0], i, rank + 1, j, s, n) for rank, (n, j) in enumerate(fits)]
    return sorted(out)


def vectors(n: int, clusters: int, labels: int, seed: int, spread: float = 0.15, dims: int = 16) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    own = rng.integers(clusters, size=n)
    return [(i, [float(v) for v in centres[k] + spread * rng.normal(size=dims)], int((k + rng.integers(3)) % labels)) for i, k in enumerate(own)]


def plain(data: list[tuple]) -> list[tuple]:
    """Distinct usable rows, quantised."""
    found = set()
    for i, v, label in data:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        found.add((i, label, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)))
    return sorted(found)


def result(spark, data: list[tuple], modulus: int = 100) -> list[tuple]:
    rows = negatives.labelled_vectors(spark.createDataFrame(data, ROWS)).cache()
    return sorted(map(tuple, negatives.hard_negatives(rows, rows.where(F.col("id") % modulus == 0)).collect()))


@pytest.fixture
def small(monkeypatch):
    """Blocks, batches and rounds so small that all of them matter."""
    for name, value in (("BLOCK_ROWS", 32), ("BATCH", 5), ("FIRST_ROWS", 40), ("GROWTH", 3), ("SAMPLE_ROWS", 300)):
        monkeypatch.setattr(negatives, name, value)


def test_clusters(spark, small):
    data = vectors(900, 12, 10, 1)
    assert result(spark, data, 30) == brute(plain(data), 30)


def test_no_structure_and_many_labels(spark, small):
    """Nothing can be left out, and some labels have too few rows for five positives."""
    rng = np.random.default_rng(2)
    data = [(i, [float(v) for v in rng.normal(size=8)], int(rng.zipf(1.5)) % 90) for i in range(500)]
    assert result(spark, data, 25) == brute(plain(data), 25)


def test_a_hot_vector_and_ties(spark, small):
    rng = np.random.default_rng(3)
    hot = [0.5, 0.25, -0.5, 0.125]
    data = [(i, hot if i % 3 == 0 else [float(v) for v in rng.integers(-2, 3, 4) / 4], i % 4) for i in range(400)]
    assert result(spark, data, 40) == brute(plain(data), 40)


def test_scans_leave_annuli_out(spark, monkeypatch):
    """On clustered rows the certified search reads a part of the blocks."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "FIRST_ROWS", 64)
    data = vectors(2000, 40, 40, 4, 0.02, 8)
    rows = negatives.labelled_vectors(spark.createDataFrame(data, ROWS)).cache()
    index = negatives.build_index(rows)
    anchors = rows.where("id % 500 = 0").withColumn("low", F.array(F.lit(-negatives.EXACT).cast("long"))).withColumn("high", F.array(F.lit(negatives.EXACT).cast("long")))
    seen = []
    real = negatives._planned

    def counted(*a):
        out = real(*a).cache()
        seen.extend((r.annulus, r.n) for r in out.collect())
        return out

    monkeypatch.setattr(negatives, "_planned", counted)
    found = index.search(anchors, True, 5).collect()
    rows_of = dict(zip(index.table.number.tolist(), index.table.rows.tolist(), strict=True))
    scanned = sum(n * rows_of[a] for a, n in seen)
    assert len(found) == 4 * 5 and scanned < 0.5 * 4 * 2000
    all_rows = plain(data)
    nearest = lambda a: sorted((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0]) for b in all_rows if b != a and b[1] == a[1])[:5]
    want = {(a[0], rank): b for a in all_rows if a[0] % 500 == 0 for rank, b in enumerate(nearest(a))}
    assert {(r.anchor_id, r["rank"] - 1): (-r.score, r.id) for r in found} == want


def test_every_row_is_indexed_once(spark, small):
    data = vectors(300, 5, 4, 6)
    index = negatives.build_index(negatives.labelled_vectors(spark.createDataFrame(data, ROWS)).cache())
    ids = [i for r in index.blocks.collect() for i in np.frombuffer(r.ids, np.int64).tolist()]
    assert sorted(ids) == list(range(300)) and sum(index.table.rows) == 300
    for r in index.blocks.select("annulus", "n", "nearest", "farthest").collect():
        assert r.n <= 32 and r.nearest <= r.farthest


def test_messy_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    data = vectors(200, 4, 5, 7, dims=6)
    data += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [nan] * 6, 1), (1003, [inf] + [0.0] * 5, 1), (1004, [-inf] * 6, 1), (None, [0.5] * 6, 1), (1005, [0.5] * 6, None)]
    data += data[:20] + [(100, [0.1] * 6, 2), (100, [0.1] * 6, 3), (0, [-0.0] * 6, 1), (2000, [], 1)]
    data += [(3000 + i, [1.0, -1.0], 2) for i in range(3)]
    padded = [(i, label, x + (0,) * (6 - len(x))) for i, label, x in plain(data)]
    assert result(spark, data, 50) == brute(padded, 50)


def test_empty_and_tiny_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0], 1)]) == []
    assert result(spark, [(0, [1.0], 1), (1, [0.5], 1), (2, [0.45], 2), (3, [0.1], 2)]) == [(0, 1, 1, 2, 256 * 128, 256 * 115)]
    assert result(spark, [(0, [1.0], 1), (1, [-0.5], 1), (2, [-0.45], 2)]) == []


def test_extra_columns_and_relabelling(spark):
    df = spark.createDataFrame(vectors(30, 2, 3, 8, dims=4), ROWS).withColumns({"id": F.lit("x"), "own": F.lit(1), "x": F.lit(2), "low": F.lit(3)})
    got = {r.id: r.label for r in negatives.labelled_vectors(df, 7, 10).collect()}
    assert got == {r.vec_id: (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label for r in df.collect()}


def test_norms_that_doubles_cannot_hold(spark):
    with pytest.raises(ValueError, match="squared norm"):
        result(spark, [(0, [3e6] * 4, 1), (1, [1.0] * 4, 1)])
