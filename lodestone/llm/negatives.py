"""Operator 12: hard negatives by one-dimensional distance keys.

Vectors are quantised to whole numbers.  With M the largest norm of all rows, a
row x is augmented by sqrt(M^2 - |x|^2) and an anchor q by 0; then the square of
their distance is |q|^2 + M^2 - 2 q.x, so the highest inner products are the
nearest rows.  A row's key is (pivot, distance to it), pivot being the nearest of
a few; rows are stored as a table sorted by that key, in blocks of ``BLOCK_ROWS``
that lie in one annulus, an interval of distances of one pivot.

By the triangle inequality |d(q, pivot) - d(x, pivot)| bounds the distance from
below, so an annulus has a highest score it can hold.  A search scans annuli in
falling order of it, in rounds of growing intervals (``FIRST_ROWS`` rows, then
``GROWTH`` times as many), and leaves out each that cannot hold a score as high as
the k-th it has found: that bound certifies the top k, so results are exact, on
any data; pivots only decide how much is scanned.  Positives are the top rows of
the anchor's label (annuli without the label are left out by a bit set).
Negatives of all positives of an anchor are found in one search with a window of
scores each.

Pivots and the edges of annuli are fitted on ``SAMPLE_ROWS`` rows, the first by
hash of the id; every row is indexed.  A task holds a batch of anchors and sends
each annulus the anchors that need it, as one packed row; these are joined with
its blocks by key, and a block scores a pack by one matrix product in doubles,
exact as norms are below 2^53.  An annulus that a hot vector fills has many
blocks; the join can be split.  The table of annuli has ``MAX_PIVOTS`` x
``MAX_ANNULI`` rows at most; it and the pivots go to the tasks with their function.

Defined results: rows with a null id, label or vector or a null or non-finite
component take no part; rows equal in id, label and quantised vector count once;
rows that only share an id are rows of their own; ties go to the smaller id; a
shorter vector counts as filled up with zeros; a squared norm of 2^53 or more
stops the job with an error; an empty table gives an empty result.  Only the id,
label and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize
from lodestone.llm.vectors import EXACT, in_batches, matrix, usable

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least LEAST / 100 of the positive's, and at most as high.
LEAST = 80
SAMPLE_ROWS = 4096
MAX_PIVOTS, MAX_ANNULI = 256, 64
BLOCK_ROWS = 1024
#: Blocks of a task that stores the index, and anchors of a batch.
TASK_BLOCKS, BATCH = 32, 512
FIRST_ROWS, GROWTH = 4096, 8
LABEL_BITS = 63
_PACK = "annulus int, n int, ids binary, own binary, labels binary, x binary, low binary, high binary"
_HITS = "anchor_id long, anchor_own long, slot int, id long, own long, score long"


def labelled_vectors(rows: DataFrame, relabel: int | None = None, classes: int = 10, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, own, label, x) of the usable rows, each once; ``own`` tells the rows of one id apart.

    With ``relabel`` the label of ids that it divides becomes (label + 1) % classes.
    """
    given = F.col(label).cast("long")
    moved = given if relabel is None else F.when(F.col(vec_id) % relabel == 0, (given + 1) % classes).otherwise(given)
    each = usable(rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull()), F.col(vec_id).cast("long").alias("id"), moved.alias("label"), vector=vector)
    return each.select("id", F.xxhash64("label", "x").alias("own"), "label", "x").distinct()


@dataclass(frozen=True)
class Keys:
    """Pivots in augmented space, edges of their annuli, and what turns distances into scores."""

    dims: int
    #: M^2, the largest squared norm.
    top: int
    pivots: np.ndarray
    edges: list[np.ndarray]

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-9 * (1 + self.top**0.5)

    def distances(self, x: np.ndarray, augment: bool) -> np.ndarray:
        """From each row to each pivot."""
        norms = (x.astype(np.float64) ** 2).sum(axis=1)
        extra = np.sqrt(np.maximum(self.top - norms, 0)) if augment else np.zeros(len(x))
        full = np.column_stack([x.astype(np.float64), extra])
        # The difference itself, not the expanded square: nothing cancels.
        return np.stack([np.sqrt(((full - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus and distance of each row."""
        d = self.distances(x, True)
        pivot = d.argmin(axis=1)
        own = d[np.arange(len(x)), pivot]
        annulus = np.array([p * MAX_ANNULI + np.searchsorted(self.edges[p], v, side="right") for p, v in zip(pivot.tolist(), own.tolist(), strict=True)], np.int32)
        return annulus, own


def fit_keys(rows: DataFrame, n: int, dims: int, top: int) -> Keys:
    """Pivots by Lloyd steps over the sample, and annuli of about a block each while MAX_ANNULI allows."""
    sample = rows.select("id", "own", "x").orderBy(F.xxhash64("id"), "id", "own").limit(SAMPLE_ROWS).collect()
    x = np.zeros((len(sample), dims))
    for own, row in zip(x, sample, strict=True):
        own[: len(row.x)] = row.x
    full = np.column_stack([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))])
    pivots = np.unique(full, axis=0)
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))[: max(1, min(MAX_PIVOTS, round(n**0.5 / 8)))]]
    nearest = lambda: np.stack([((full - p) ** 2).sum(axis=1) for p in pivots], axis=1).argmin(axis=1)
    for _ in range(5):
        own = nearest()
        pivots = np.stack([full[own == i].mean(axis=0) if (own == i).any() else p for i, p in enumerate(pivots)])
    keys = Keys(dims, top, pivots, [np.zeros(0)] * len(pivots))
    d, own = keys.distances(x.astype(np.int64), True), nearest()
    edges = []
    for i in range(len(pivots)):
        wanted = max(1, min(MAX_ANNULI, round(n * (own == i).mean() / BLOCK_ROWS)))
        at = d[own == i, i]
        edges.append(np.unique(np.quantile(at, np.arange(1, wanted) / wanted)) if len(at) and wanted > 1 else np.zeros(0))
    return Keys(dims, top, pivots, edges)


def _binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def stored_blocks(rows: DataFrame, keys: Keys, n: int) -> DataFrame:
    """The rows in blocks, sorted by (pivot, distance): annulus, n, nearest, farthest, bits of labels, and packed ids, own, labels, x."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, BLOCK_ROWS):
            x = matrix(batch.column(3), keys.dims)
            annulus, distance = keys.placed(x)
            packed = pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed, pa.array(annulus), pa.array(distance)], ["id", "own", "label", "x", "annulus", "distance"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, BLOCK_ROWS):
            annulus = batch.column(4).to_numpy()
            starts = np.flatnonzero(np.diff(annulus, prepend=-1))
            parts = [batch.slice(a, b - a) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(annulus)], strict=True)]
            labels = [p.column(2).to_numpy() for p in parts]
            columns = {
                "annulus": pa.array(annulus[starts]),
                "n": pa.array([p.num_rows for p in parts], pa.int32()),
                "nearest": pa.array([p.column(5).to_numpy().min() for p in parts], pa.float64()),
                "farthest": pa.array([p.column(5).to_numpy().max() for p in parts], pa.float64()),
                "bits": pa.array([int(np.bitwise_or.reduce(np.left_shift(np.int64(1), v % LABEL_BITS))) for v in labels], pa.int64()),
                "ids": pa.array([_binary(p.column(0).to_numpy()) for p in parts], pa.binary()),
                "own": pa.array([_binary(p.column(1).to_numpy()) for p in parts], pa.binary()),
                "labels": pa.array([_binary(v) for v in labels], pa.binary()),
                "x": pa.array([b"".join(p.column(3).to_pylist()) for p in parts], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    keyed = materialize(rows.select("id", "own", "label", "x").mapInArrow(place, "id long, own long, label long, x binary, annulus int, distance double"), "negatives-keys")
    parts = 1 + n // (TASK_BLOCKS * BLOCK_ROWS)
    order = ("annulus", "distance", "id", "own")
    blocks = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "annulus int, n int, nearest double, farthest double, bits long, ids binary, own binary, labels binary, x binary")
    return materialize(blocks, "negatives-index")


@dataclass(frozen=True)
class Annuli:
    """The table of annuli: number, rows, least and largest distance, bits of labels."""

    number: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bits: np.ndarray


def annuli(blocks: DataFrame) -> Annuli:
    """At most MAX_PIVOTS x MAX_ANNULI rows."""
    found = blocks.groupBy("annulus").agg(F.sum("n"), F.min("nearest"), F.max("farthest"), F.bit_or("bits")).orderBy("annulus").collect()
    columns = list(zip(*found, strict=True)) or [()] * 5
    return Annuli(*(np.array(c, t) for c, t in zip(columns, (np.int64, np.int64, float, float, np.int64), strict=True)))


def _planned(anchors: DataFrame, keys: Keys, table: Annuli, same: bool, k: int, before: int, upto: int) -> DataFrame:
    """The anchors, packed, by annulus that they have to scan: of those at rows ``before`` to ``upto`` in falling order of the score they can hold."""

    def needed(x: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        norms = (x.astype(np.float64) ** 2).sum(axis=1)[:, None]
        d = keys.distances(x, False)[:, table.number // MAX_ANNULI]
        least = np.maximum(np.maximum(table.near - d, d - table.far) - keys.slack, 0)
        highest = (norms + keys.top - least**2) / 2 + 1
        lowest = (norms + keys.top - (d + table.far + keys.slack) ** 2) / 2 - 1
        order = np.argsort(-highest, axis=1, kind="stable")
        starts = np.empty_like(order)
        np.put_along_axis(starts, order, np.cumsum(table.rows[order], axis=1) - table.rows[order], axis=1)
        want = (starts >= before) & (starts < upto)
        if same:
            want &= (np.left_shift(np.int64(1), labels % LABEL_BITS)[:, None] & table.bits) != 0
        some = np.zeros_like(want)
        for i in range(low.shape[1]):
            some |= (highest >= low[:, i : i + 1]) & (lowest <= high[:, i : i + 1]) & (low[:, i : i + 1] <= high[:, i : i + 1])
        return want & some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, BATCH):
            x = matrix(batch.column(3), keys.dims)
            ids, own, labels = (batch.column(i).to_numpy() for i in range(3))
            lows, highs, full = (batch.column(i).to_pylist() for i in (4, 5, 6))
            slots = max(map(len, lows), default=0)
            low, high = np.full((len(x), slots), 1, np.int64), np.zeros((len(x), slots), np.int64)
            for i, (a, b, done) in enumerate(zip(lows, highs, full, strict=True)):
                low[i, : len(a)], high[i, : len(b)] = a, b
                for slot in done or []:
                    low[i, slot["slot"]] = max(low[i, slot["slot"]], slot["kth"])
            # A few at a time: these tables have a column for each annulus.
            want = np.concatenate([needed(x[i : i + 64], labels[i : i + 64], low[i : i + 64], high[i : i + 64]) for i in range(0, len(x), 64)])
            for at in np.flatnonzero(want.any(axis=0)).tolist():
                m = want[:, at]
                packed = [_binary(a[m]) for a in (ids, own, labels, x.astype(np.int32), low, high)]
                columns = [pa.array([int(table.number[at])], pa.int32()), pa.array([int(m.sum())], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)]
                yield pa.RecordBatch.from_arrays(columns, ["annulus", "n", "ids", "own", "labels", "x", "low", "high"])

    return anchors.select("id", "own", "label", "x", "low", "high", "full").mapInArrow(run, _PACK)


def _scored(packs: DataFrame, blocks: DataFrame, keys: Keys, same: bool, k: int) -> DataFrame:
    """The best k rows of each block for each anchor and slot of each pack that scans it."""
    right = blocks.select("annulus", *[F.col(c).alias(f"b_{c}") for c in ("ids", "own", "labels", "x")])
    names = ("n", "ids", "own", "labels", "x", "low", "high", "b_ids", "b_own", "b_labels", "b_x")

    def best(valid: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        found = np.flatnonzero(valid)
        if len(found) > k:
            least = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= least]
        return found[np.lexsort((ids[found], -scores[found]))[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, *raw = (c[row].as_py() for c in batch.columns)
                ids, own, labels = (np.frombuffer(v, np.int64) for v in raw[:3])
                q = np.frombuffer(raw[3], np.int32).reshape(n, -1)
                low, high = (np.frombuffer(v, np.int64).reshape(n, -1) for v in raw[4:6])
                b_ids, b_own, b_labels = (np.frombuffer(v, np.int64) for v in raw[6:9])
                x = np.frombuffer(raw[9], np.int32).reshape(len(b_ids), -1)
                scores = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
                fits = (labels[:, None] == b_labels) == same
                fits &= (ids[:, None] != b_ids) | (own[:, None] != b_own)
                hits = []
                for slot in range(low.shape[1]):
                    valid = fits & (scores >= low[:, slot : slot + 1]) & (scores <= high[:, slot : slot + 1])
                    for i in np.flatnonzero(valid.any(axis=1)).tolist():
                        at = best(valid[i], scores[i], b_ids)
                        hits.append((i, slot, at))
                if hits:
                    each = np.array([len(at) for _, _, at in hits])
                    who, slot, at = np.repeat([i for i, _, _ in hits], each), np.repeat([s for _, s, _ in hits], each), np.concatenate([at for _, _, at in hits])
                    columns = [ids[who], own[who], slot.astype(np.int32), b_ids[at], b_own[at], scores[who, at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "anchor_own", "slot", "id", "own", "score"])

    return packs.join(right, "annulus").select(*names).mapInArrow(run, _HITS)


@dataclass(frozen=True)
class Index:
    keys: Keys
    blocks: DataFrame
    table: Annuli
    n: int

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, anchor_own, slot, rank, id, own, score): the first k rows in each window of scores.

        ``anchors`` has (id, own, label, x) and arrays ``low`` and ``high`` with a
        window a slot; rows of the anchor's label (``same``) or of others count.
        """
        slot = Window.partitionBy("anchor_id", "anchor_own", "slot").orderBy(F.desc("score"), "id", "own")
        ranked = anchors.sparkSession.createDataFrame([], f"{_HITS}, rank int")
        before, upto = 0, FIRST_ROWS
        while before < self.n:
            full = ranked.where(F.col("rank") == k).groupBy(F.col("anchor_id").alias("id"), F.col("anchor_own").alias("own")).agg(F.collect_list(F.struct("slot", F.col("score").alias("kth"))).alias("full"))
            packs = materialize(_planned(anchors.join(full, ["id", "own"], "left"), self.keys, self.table, same, k, before, upto), "negatives-packs")
            hits = _scored(packs, self.blocks, self.keys, same, k).unionByName(ranked.drop("rank"))
            ranked = materialize(hits.withColumn("rank", F.row_number().over(slot)).where(F.col("rank") <= k), "negatives-found")
            before, upto = upto, upto * GROWTH
        return ranked


def build_index(rows: DataFrame) -> Index | None:
    """The index over (id, own, label, x); None if there are no rows."""
    squares = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    n, dims, top = rows.agg(F.count("*"), F.max(F.size("x")), F.max(squares)).first()
    if not n:
        return None
    if top >= EXACT:
        raise ValueError("The squared norm of a quantised vector is 2^53 or more; scale the vectors down.")
    keys = fit_keys(rows, n, max(1, dims), int(top))
    blocks = stored_blocks(rows, keys, n)
    return Index(keys, blocks, annuli(blocks), n)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``anchors``, a part of ``rows`` (id, own, label, x)."""
    index = build_index(rows)
    if index is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    count = anchors.count()
    # Batches of anchors, so that packs are large.
    dealt = materialize(anchors.repartition(1 + count // BATCH), "negatives-anchors")
    every = [F.array(F.lit(v).cast("long")) for v in (-EXACT, EXACT)]
    near = index.search(dealt.withColumn("low", every[0]).withColumn("high", every[1]), True, positives)

    # The least whole number that is not below score * least / 100.
    lowest = F.expr(f"(score * {least} + 99 - pmod(score * {least} + 99, 100L)) div 100")
    windows = near.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_own").alias("own")).agg(F.sort_array(F.collect_list(F.struct("rank", lowest.alias("low"), F.col("score").alias("high")))).alias("w"))
    wanted = materialize(dealt.join(windows, ["id", "own"]).select("id", "own", "label", "x", F.col("w.low").alias("low"), F.col("w.high").alias("high")).repartition(1 + count // BATCH), "negatives-windows")
    far = index.search(wanted, False, negatives)
    chosen = near.select("anchor_id", "anchor_own", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.select("anchor_id", "anchor_own", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(found, ["anchor_id", "anchor_own", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
