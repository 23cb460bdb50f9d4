"""Operator 4: documents that contain a benchmark item.

Words are the runs between white space and ASCII punctuation of the lower-cased
text.  For each benchmark item every window of the same number of words, at every
position of every text, is a candidate; at both ends of a text windows overhang
it by any number of words, so that a part of an item at an edge, or a text that is
shorter than the item, is compared with what is there.

A shingle is a run of five words.  It counts as often as it occurs, times
log(1 + items / items that have it), so that wording which many items share
weighs less.  The weighted Jaccard similarity of the shingles of the item and of
the window must be ``SIMILARITY`` or more.

Windows and items have SimHash fingerprints of 64 bits, summed with the same
weights.  A fingerprint is cut into ``BLOCKS`` blocks.  Two fingerprints within
``RADIUS`` bits are within ``RADIUS // BLOCKS`` bits in one block at least, so the
index holds, for each block of each item, all values within that distance, in one
sorted table with the window's size; a window looks its blocks up there and finds
every item within the radius.  What is within the radius is verified by the exact
similarity.  Fingerprints of texts with a similarity of 0.8 differ in about ten
bits, and in more than ``RADIUS`` with a chance of about 1 in 100,000.

A window's fingerprint is only computed where it can matter: its shingles that
any item has hold all that it can share with one, so a window whose weight of
those is below ``SIMILARITY`` times the item's cannot be similar enough.  This
bound is exact and passes over nearly all of a corpus.

Texts run through in pieces of ``PIECE_WORDS`` words that overlap by the largest
window, so memory does not grow with a text.  A benchmark of more than
``PART_CHARS`` characters or ``PART_ITEMS`` items (of about 15 KB of index each) is
searched for in parts, each against all rows; the
driver builds the index of one part after the other and holds none, and a task
holds one part at a time for each part's step.

Defined results: null and empty texts, and items of fewer than five words, match
nothing; equal items each match; a document matches an item once, at the best and
of equals the first window; repeated rows match like any other; empty tables give an
empty result.  Only ``doc_id``, ``text``, ``item_id`` are read; other columns of
the documents pass through :func:`without_leaks`.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 6
#: What sums of floats may be off.
SLACK = 1e-6
PART_CHARS, PART_ITEMS = 1_000_000, 8192
PIECE_WORDS = 1 << 15

_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words))


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of SHINGLE words."""
    n = len(hashes) - SHINGLE + 1
    if n < 1:
        return np.empty(0, "<u8")
    mixed = np.zeros(n, "<u8")
    for i in range(SHINGLE):
        mixed = (mixed ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _sums(weights: np.ndarray) -> np.ndarray:
    """Running sums along the first axis, from zero."""
    return np.concatenate((np.zeros_like(weights[:1], dtype=float), np.cumsum(weights, axis=0, dtype=float)))


def _signed_bits(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row a shingle: its weight for each bit that is set in its hash, minus the weight for the others."""
    mixed = (shingles ^ (shingles >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bits = np.unpackbits((mixed ^ (mixed >> np.uint64(32))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.where(bits, weights[:, None], -weights[:, None])


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


#: (shift, mask, all patterns of up to RADIUS // BLOCKS bits) of each block.
_CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def _near(width: int) -> np.ndarray:
    return np.array([sum(1 << b for b in some) for n in range(RADIUS // BLOCKS + 1) for some in combinations(range(width), n)], np.int64)


_BLOCKS = [(a, (1 << b - a) - 1, _near(b - a)) for a, b in zip(_CUTS, _CUTS[1:], strict=False)]
#: Values of a block, at most.
_VALUES = 1 << max(b - a for a, b in zip(_CUTS, _CUTS[1:], strict=False))


def _block_keys(fingerprints: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    shift, mask, _ = _BLOCKS[block]
    values = (fingerprints >> np.uint64(shift)).astype(np.int64) & mask
    return (sizes * BLOCKS + block) * _VALUES + values


@dataclass
class Probes:
    """The items of a part of the benchmark, and their multi-index."""

    ids: list[int | None]
    sizes: np.ndarray
    values: list[np.ndarray]
    counts: list[np.ndarray]
    totals: np.ndarray
    fingerprints: np.ndarray
    known: np.ndarray
    known_weights: np.ndarray
    default_weight: float
    keys: np.ndarray
    key_items: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int | None, str | None]], n_items: int, frequency: dict[int, int]) -> Probes:
        """``frequency`` has the shingles that two items or more share."""
        cut = [(item_id, shingles_of(word_hashes(words_of(text)))) for item_id, text in items]
        cut = [(item_id, h) for item_id, h in cut if len(h)]
        known = np.unique(np.concatenate([h for _, h in cut])) if cut else np.empty(0, "<u8")
        known_weights = np.log1p(n_items / np.array([frequency.get(v, 1) for v in known.tolist()], float))
        weights = [known_weights[np.searchsorted(known, h)] for _, h in cut]
        own = [np.unique(h, return_counts=True) for _, h in cut]
        sums = [_signed_bits(h, w).sum(axis=0) for (_, h), w in zip(cut, weights, strict=True)]
        fingerprints = _packed(np.array(sums)) if cut else np.empty(0, "<u8")
        sizes = np.array([len(h) for _, h in cut], np.int64)
        keys = [(_block_keys(fingerprints, sizes, b)[:, None] ^ near).reshape(-1) for b, (_, _, near) in enumerate(_BLOCKS)]
        key_items = [np.repeat(np.arange(len(cut)), len(near)) for _, _, near in _BLOCKS]
        keys, key_items = np.concatenate(keys), np.concatenate(key_items).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        return cls(
            [item_id for item_id, _ in cut], sizes, [v for v, _ in own], [n for _, n in own], np.array([w.sum() for w in weights]), fingerprints,
            known, known_weights, float(np.log1p(n_items)), keys[order], key_items[order],
        )

    @property
    def longest(self) -> int:
        return int(self.sizes.max(initial=0))

    def shared_weights(self, shingles: np.ndarray) -> np.ndarray:
        """The weight of each shingle, 0 if no item has it."""
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.known_weights[at], 0.0)

    def within_radius(self, size: int, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of a size within RADIUS bits."""
        windows, items = [], []
        sizes = np.full(len(fingerprints), size, np.int64)
        for block in range(BLOCKS):
            wanted = _block_keys(fingerprints, sizes, block)
            low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            windows.append(np.repeat(np.arange(len(wanted)), n))
            items.append(self.key_items[at])
        window, item = np.concatenate(windows), np.concatenate(items)
        near = np.bitwise_count(fingerprints[window] ^ self.fingerprints[item]) <= RADIUS
        pairs = np.unique(window[near] * len(self.ids) + item[near])
        return pairs // len(self.ids), pairs % len(self.ids)

    def similarity(self, item: int, window: np.ndarray, weights: np.ndarray) -> float:
        values, first, n = np.unique(window, return_index=True, return_counts=True)
        own = self.values[item]
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        both = float((weights[first] * np.where(own[at] == values, np.minimum(n, self.counts[item][at]), 0)).sum())
        return both / (float(self.totals[item]) + float(weights.sum()) - both)

    def search(self, shingles: np.ndarray, shared: np.ndarray, opens: bool, closes: bool) -> Iterator[tuple[int, int, int, float]]:
        """(item, start, stop, similarity) in shingles of a part of a text, which begins or ends the text or not."""
        n, least = len(shingles), SIMILARITY - SLACK
        in_any, weights = _sums(shared), np.where(shared > 0, shared, self.default_weight)
        for size in np.unique(self.sizes[in_any[-1] >= least * self.totals]).tolist():
            begins = np.arange(1 - size if opens else 0, n if closes else n - size + 1)
            start, stop = np.maximum(begins, 0), np.minimum(begins + size, n)
            bound = in_any[stop] - in_any[start]
            could = np.flatnonzero(bound >= least * self.totals[self.sizes == size].min())
            if not len(could):
                continue
            # Only the stretch that these windows cover is fingerprinted.
            start, stop, bound = start[could], stop[could], bound[could]
            low, high = int(start.min()), int(stop.max())
            sums = _sums(_signed_bits(shingles[low:high], weights[low:high]))
            window, item = self.within_radius(size, _packed(sums[stop - low] - sums[start - low]))
            for i, j in zip(window.tolist(), item.tolist(), strict=True):
                if bound[i] >= least * self.totals[j]:
                    a, b = int(start[i]), int(stop[i])
                    similarity = self.similarity(j, shingles[a:b], weights[a:b])
                    if similarity >= SIMILARITY:
                        yield j, a, b, similarity


def _pieces(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int, bool]]]]:
    """Shingles of several texts, and (row, its first word, start, stop, whether the text ends) of each part of them."""
    parts, spans, filled = [], [], 0
    for row, text in enumerate(texts):
        hashes = shingles_of(word_hashes(words_of(text)))
        for at in range(0, len(hashes), PIECE_WORDS):
            part = hashes[at : at + PIECE_WORDS + overlap]
            spans.append((row, at, filled, filled + len(part), at + len(part) == len(hashes)))
            parts.append(part)
            filled += len(part)
            if filled >= PIECE_WORDS:
                yield np.concatenate(parts), spans
                parts, spans, filled = [], [], 0
    if parts:
        yield np.concatenate(parts), spans


def _matches(probes: Probes, texts: list[str | None]) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(row, item) -> (similarity, -first word, shingles) of the best window."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not probes.ids:
        return best
    enough = (SIMILARITY - SLACK) * probes.totals.min()
    for shingles, spans in _pieces(texts, probes.longest):
        shared = probes.shared_weights(shingles)
        if shared.sum() < enough:
            continue
        for row, first, start, stop, closes in spans:
            if shared[start:stop].sum() < enough:
                continue
            for item, a, b, similarity in probes.search(shingles[start:stop], shared[start:stop], first == 0, closes):
                key, value = (row, item), (round(similarity, 6), -(first + a), b - a)
                if key not in best or value > best[key]:
                    best[key] = value
    return best


def benchmark_parts(benchmark: DataFrame) -> list[Broadcast]:
    """The benchmark as broadcast probes, in parts of about PART_CHARS characters, built one after the other."""
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n_parts = 1 + max((size.chars or 0) // PART_CHARS, size.n // PART_ITEMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                own = np.unique(shingles_of(word_hashes(words_of(text.as_py()))))
                yield pa.RecordBatch.from_arrays([pa.array(own.view("<i8"))], ["h"])

    shingles = benchmark.select("text").mapInArrow(count, "h long")
    shared = shingles.groupBy("h").count().where("count > 1")
    parts = []
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts))
    for part in range(n_parts):
        rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(part_of == part)
        items = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        mine = rows.select("text").mapInArrow(count, "h long").distinct().join(shared, "h").collect()
        # A broadcast is a file on the driver; the probes themselves are not kept.
        parts.append(benchmark.sparkSession.sparkContext.broadcast(Probes.build(items, size.n, {r.h % (1 << 64): r["count"] for r in mine})))
    return parts


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) of each document and item that it contains."""
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"

    def search(part: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probes = part.value
            for batch in batches:
                ids = batch.column(0)
                found = sorted(_matches(probes, batch.column(1).to_pylist()).items())
                columns = [
                    ids.take(pa.array([row for (row, _), _ in found], pa.int64())),
                    pa.array([probes.ids[item] for (_, item), _ in found], pa.int64()),
                    pa.array([-v[1] for _, v in found], pa.int64()),
                    pa.array([v[2] + SHINGLE - 1 for _, v in found], pa.int64()),
                    pa.array([v[0] for _, v in found], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return reduce(DataFrame.union, (rows.mapInArrow(search(p), schema) for p in benchmark_parts(benchmark)))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; each is judged where it is read."""

    def leaking(part: Broadcast) -> Column:
        @F.arrow_udf("boolean")
        def found(texts: pa.Array) -> pa.Array:
            rows = {row for row, _ in _matches(part.value, texts.to_pylist())}
            return pa.array([row in rows for row in range(len(texts))], pa.bool_())

        return found(F.col("text").cast("string"))

    return reduce(lambda rows, part: rows.where(~leaking(part)), benchmark_parts(benchmark), docs)
