"""Operator 5: language identification by cross-parsing entropy.

For each language a suffix automaton over labelled text answers how far a match
with that text reaches.  A text is parsed greedily into phrases, each the longest
match from where the last one ended; the language that needs the fewest phrases,
times log2 of the length of its reference over the number of characters, wins
(Ziv and Merhav's cross parsing).  Ties go to the first language by name.

The reference is fitted on a bounded sample of labelled rows: the whole texts of
the ``SAMPLE_ROWS`` rows of each language that come first by hash of the id, of those
with ``SAMPLE_CHARS`` characters at most; of a language that has only longer ones,
its shortest row.  Every prediction reads the whole text, and every language that
has a label is learnt.  The automata of ``GROUP`` languages are one table;
with more languages each row passes one group after the other and keeps its best.

Texts are lower-cased, and what is neither letter nor mark becomes one space.  A
table of transitions is sparse, so characters have no limit either: the symbols
of a state lie at its base plus the symbol's number, where no other state has one.

Texts are parsed in segments, many side by side in arrays.  First each segment
by itself, noting where its phrases begin; then each segment is begun again with
the state that the one before it ends in, until a phrase begins where one began
before, from where on both parses agree.  The phrases are those of the whole text.

Defined results: null text and text without a letter is ``und`` with score 0, as
is everything if there is nothing to learn from; rows whose language or text is
null teach nothing; repeated rows are predicted alike; an empty table gives an
empty result.  Only ``doc_id`` and ``text`` are inputs of a prediction.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import doc_bucket, materialize

UNKNOWN = "und"
FOLDS = 5
SAMPLE_ROWS = 16
SAMPLE_CHARS = 3000
#: Languages whose automata share a table.
GROUP = 32
#: Places that are tried for a state of several symbols.
TRIES = 64
SEGMENT = 256
BLOCK_CHARS = 1 << 20

_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normalized(text: str | None) -> str:
    """Lower-cased words of letters and marks; empty if there is no letter."""
    found = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return found if _LETTER.search(found) else ""


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return move


def _placed(moves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base by state; owner and target by slot: state s goes by symbol c to target[base[s] + c] if owner[base[s] + c] is s.

    States with several symbols are tried at random places of a table that stays
    half empty, those with most symbols first, and go behind it if none fits;
    states with one symbol fill what is free.
    """
    rng = random.Random(0)
    width = 1 + max((max(m) for m in moves if m), default=0)
    # Bases are never negative, as slots begin at the width.
    size = width + 2 * sum(map(len, moves)) + 1
    owner, base = bytearray(size + width), np.zeros(len(moves), np.int32)
    taken: list[tuple[int, int, int]] = []
    for s in sorted((s for s, m in enumerate(moves) if len(m) > 1), key=lambda s: -len(moves[s])):
        symbols = sorted(moves[s])
        offsets = [c - symbols[0] for c in symbols]
        for _ in range(TRIES):
            at = rng.randrange(width, size)
            if not any(owner[at + d] for d in offsets):
                break
        else:
            at = len(owner)
            owner.extend(bytes(offsets[-1] + 1))
        base[s] = at - symbols[0]
        for c, d in zip(symbols, offsets, strict=True):
            owner[at + d] = 1
            taken.append((at + d, s, moves[s][c]))
    single = [(s, c, to) for s, m in enumerate(moves) if len(m) == 1 for c, to in m.items()]
    owner.extend(bytes(len(single)))
    free = np.flatnonzero(np.frombuffer(owner, np.uint8)[width:] == 0)[: len(single)] + width
    one = np.array(single, np.int64).reshape(-1, 3)
    base[one[:, 0]] = free - one[:, 1]
    many = np.array(taken, np.int64).reshape(-1, 3)
    n_slots = int(max(many[:, 0].max(initial=0), free.max(initial=0), base.max(initial=0))) + width + 2
    owners, targets = np.full(n_slots, -1, np.int32), np.zeros(n_slots, np.int32)
    owners[many[:, 0]], targets[many[:, 0]] = many[:, 1], many[:, 2]
    owners[free], targets[free] = one[:, 0], one[:, 2]
    return base, owners, targets


@dataclass
class Parser:
    """The automata of some languages as one sparse table.

    Symbol 0 matches nothing and is a phrase of its own; the last symbol pads.
    ``begun[language, symbol]`` is the state after a phrase began with the symbol.
    """

    languages: list[str]
    symbols: dict[int, int]
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    begun: np.ndarray
    starts: np.ndarray
    log_lengths: np.ndarray

    @classmethod
    def build(cls, references: dict[str, str]) -> Parser:
        languages = sorted(references)
        seen = Counter("".join(references.values()))
        symbols = {ord(c): i + 1 for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))}
        moves: list[dict[int, int]] = []
        begun, starts = np.zeros((len(languages), len(symbols) + 2), np.int32), []
        for i, language in enumerate(languages):
            at = len(moves)
            own = suffix_automaton([symbols[ord(c)] for c in references[language]])
            moves += [{c: to + at for c, to in m.items()} for m in own]
            # The state between phrases, where any symbol begins a phrase.
            moves.append({})
            starts.append(len(moves) - 1)
            begun[i] = starts[-1]
            begun[i, list(own[0])] = [to + at for to in own[0].values()]
        base, owner, target = _placed(moves)
        # Padding has the highest symbol, beyond those that states have.
        owner, target = (np.concatenate([x, np.full(2, fill, np.int32)]) for x, fill in ((owner, -1), (target, 0)))
        lengths = np.array([max(2, len(references[x])) for x in languages], float)
        return cls(languages, symbols, base, owner, target, begun, np.array(starts, np.int32), np.log2(lengths))

    @property
    def pad(self) -> int:
        return self.begun.shape[1] - 1

    def phrases(self, symbols: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases by language and segment, of a (position, segment) array of symbols.

        ``follows``: whether a segment goes on with the text of the one before it.
        """
        n_languages, n = len(self.languages), symbols.shape[1]
        state = np.repeat(self.starts[:, None], n, axis=1)
        begins = np.empty((len(symbols), n_languages, n), bool)
        for at, row in enumerate(symbols):
            slot = self.base.take(state) + row
            np.not_equal(self.owner.take(slot), state, out=begins[at])
            state = np.where(begins[at], self.begun.take(row, axis=1), self.target.take(slot))
        count = begins.sum(axis=0, dtype=np.int32).reshape(-1) - np.tile((symbols == self.pad).sum(axis=0, dtype=np.int32), n_languages)

        # From here on a lane is a segment in a language; it is parsed again from where the one before it ends.
        alone, begins = state.reshape(-1), begins.reshape(len(symbols), -1)
        ends, change = alone.copy(), np.zeros(len(count), np.int32)
        again = np.flatnonzero(np.tile(follows, n_languages))
        while len(again):
            change[again] = 0
            lanes, state, moved = again, ends[again - 1], []
            before = ends[again].copy()
            ends[again] = alone[again]
            for at, row in enumerate(symbols):
                symbol = row[lanes % n]
                slot = self.base.take(state) + symbol
                began, did = self.owner.take(slot) != state, begins[at].take(lanes)
                change[lanes] += began.astype(np.int32) - did
                left = np.flatnonzero(~(began & did))
                if not len(left):
                    lanes = lanes[:0]
                    break
                state = np.where(began, self.begun[lanes // n, symbol], self.target.take(slot))[left]
                lanes = lanes[left]
            ends[lanes] = state[: len(lanes)]
            moved = again[ends[again] != before] + 1
            moved = moved[moved % n != 0]
            again = moved[follows[moved % n]]
        return (count + change).reshape(n_languages, n)

    def costs(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Phrases times log2 of the reference's length, of each language, for normalised texts; by blocks of texts."""
        lookup = np.zeros(0x110000, np.int32)
        lookup[list(self.symbols)] = list(self.symbols.values())
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text) + SEGMENT
            if size >= BLOCK_CHARS:
                yield self._block(block, lookup)
                block, size = [], 0
        if block:
            yield self._block(block, lookup)

    def _block(self, texts: list[str], lookup: np.ndarray) -> np.ndarray:
        n_segments = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), n_segments)
        symbols, first = np.full((len(owner), SEGMENT), self.pad, np.int32), 0
        for text, n in zip(texts, n_segments.tolist(), strict=True):
            symbols[first : first + n].reshape(-1)[: len(text)] = lookup[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
            first += n
        follows = np.concatenate(([False], owner[1:] == owner[:-1])) if len(owner) else np.zeros(0, bool)
        count = self.phrases(np.ascontiguousarray(symbols.T), follows)
        return np.array([np.bincount(owner, c, len(texts)) for c in count]).T * self.log_lengths

    def best(self, texts: list[str]) -> Iterator[tuple[str, float, float]]:
        """(language, its cost, the next best cost or infinity) of normalised texts."""
        for costs in self.costs(texts):
            order = np.argsort(costs, axis=1, kind="stable")
            for own, (i, *more) in zip(costs, order.tolist(), strict=True):
                yield self.languages[i], float(own[i]), float(own[more[0]]) if more else float("inf")


def sample_rows(labelled: DataFrame) -> DataFrame:
    """(lang, nth, text): the sample of each language, from rows (doc_id, text, lang)."""
    size = F.length("text")
    order = Window.partitionBy("lang").orderBy(F.when(size > SAMPLE_CHARS, size).asc_nulls_first(), F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    usable = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    numbered = usable.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_ROWS)
    return numbered.where((size <= SAMPLE_CHARS) | (F.col("nth") == 1)).select("lang", "nth", "text")


def references(rows: DataFrame) -> dict[str, str]:
    """Language -> reference text, of rows of :func:`sample_rows`."""
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in rows.collect():
        parts.setdefault(row.lang, []).append((row.nth, normalized(row.text)))
    texts = {language: "\n".join(part for _, part in sorted(own) if part) for language, own in parts.items()}
    return {language: text for language, text in texts.items() if text}


def parsers(labelled: DataFrame) -> list[Broadcast]:
    """The parsers of all languages, a group of GROUP after the other; the driver holds one at a time."""
    sample = materialize(sample_rows(labelled), "langid-sample")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    groups = (references(sample.where(F.col("lang").isin(languages[at : at + GROUP]))) for at in range(0, len(languages), GROUP))
    return [labelled.sparkSession.sparkContext.broadcast(Parser.build(found)) for found in groups if found]


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``, learnt from ``labelled``."""
    names = ("doc_id", "text", "lang", "cost", "next_cost")

    def group(part: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                found = list(part.value.best(texts))
                languages, costs, others = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for i, (language, cost, other) in enumerate(found):
                    if cost < costs[i]:
                        languages[i], costs[i], others[i] = language, cost, min(other, costs[i])
                    else:
                        others[i] = min(others[i], cost)
                columns = [batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(costs, pa.float64()), pa.array(others, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names)

        return run

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalized(t) for t in batch.column(1).to_pylist()]
            none = pa.array([float("inf")] * len(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.nulls(len(texts), pa.string()), none, none], names)

    schema = "doc_id long, text string, lang string, cost double, next_cost double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(prepare, schema)
    for part in parsers(labelled):
        rows = rows.mapInArrow(group(part), schema)
    known = (F.col("text") != "") & F.col("lang").isNotNull()
    score = F.when(F.col("next_cost") == float("inf"), 1.0).otherwise(1 - F.col("cost") / F.col("next_cost"))
    return rows.select("doc_id", F.when(known, F.col("lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"))


def held_out(fold: int = 0):
    return doc_bucket(F.col("doc_id"), FOLDS) == fold
