"""Operator 6: secrets, found by one automaton for all rules in one pass over the bytes.

The rules are compiled by subset construction into one minimal deterministic
automaton (:mod:`lodestone.llm.automaton`) that is run once over the UTF-8 bytes
of a text and notes which rules have a match that ends where.  The texts of a
batch go side by side: a step moves all of them by one byte, in arrays, and the
last few, long ones go on byte by byte.  Texts without such an end, nearly all,
are done.

In that automaton a rule ends with the first byte of its last repetition: where
that matches, the rule does.  What the repetition goes on with is not a state, so
the states of the rules do not multiply by those of each other's tails (about 450
in all; a test holds it below 1500).  For a rule that has an end, the automaton of
the rule reversed, cut the same way, is run back from its last end and marks where
matches begin; from the leftmost beginning the whole rule's own automaton runs on
to the longest end, and so on behind it: leftmost, non-overlapping, longest
matches.  For these rules that is what a backtracking regex engine finds.

Matches that are too short are dropped after they were found: an assignment
needs a value of six characters, the others a total length.

Defined results: null text is empty; offsets count code points, ends are
exclusive; repeated rows are scanned alike; an empty table gives an empty result.
Spans of different rules may overlap.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.automaton import Automaton, Pattern, alt, chars, compile_patterns, opt, plus, reverse, seq, star, word

_UPPER, _LOWER, _DIGIT = string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), string.digits.encode()
_ALNUM = _UPPER + _LOWER + _DIGIT
_VALUE = chars(_ALNUM + b"+/_.=-")
_URL = chars(_ALNUM + b"_-")
_QUOTE = opt(chars(b"\"'"))
_SPACES = star(chars(b" "))
_HEX = chars(_DIGIT + b"abcdef")

#: The base rules first, in the order of their kinds; then (kind, pattern, least length in bytes).
RULES: tuple[tuple[str, Pattern, int], ...] = (
    (
        "assign",
        seq(
            alt(*(word(k, any_case=True) for k in ("password", "passwd", "secret", "token", "apikey", "api_key"))),
            _QUOTE, _SPACES, chars(b":="), _SPACES, _QUOTE, plus(_VALUE),
        ),
        0,
    ),
    ("access", seq(word("AKIA"), plus(chars(_UPPER + _DIGIT))), 20),
    # Runs below 24 are dropped; that those below 8 are not found only saves work.
    ("hex", seq(*[_HEX] * 7, plus(_HEX)), 24),
    ("github", seq(word("gh"), chars(b"pousr"), word("_"), plus(chars(_ALNUM))), 40),
    ("slack", seq(word("xox"), chars(b"abprs"), word("-"), plus(chars(_ALNUM + b"-"))), 20),
    ("google", seq(word("AIza"), plus(_URL)), 39),
    ("jwt", seq(word("eyJ"), plus(_URL), word("."), word("eyJ"), plus(_URL), word("."), plus(_URL)), 40),
    ("private_key", seq(word("-----BEGIN "), star(chars(_UPPER + b" ")), word("PRIVATE KEY-----")), 0),
)
BASE = ("assign", "access", "hex")
MIN_VALUE = 6


#: With fewer texts left than this, a batch goes on text by text.
FEW_TEXTS = 24

Automata = tuple[Automaton, list[Automaton], list[Automaton]]


def _cut(pattern: Pattern) -> Pattern:
    """The pattern with one round of its last repetition."""
    kind, *parts = pattern
    if kind == "plus":
        return parts[0]
    return ("seq", *parts[:-1], _cut(parts[-1])) if kind == "seq" and parts else pattern


@lru_cache(maxsize=1)
def automata() -> Automata:
    """All rules, cut, anywhere; each rule from a place; each cut rule reversed, anywhere."""
    patterns = [p for _, p, _ in RULES]
    return (
        compile_patterns([_cut(p) for p in patterns], anywhere=True),
        [compile_patterns([p], anywhere=False) for p in patterns],
        [compile_patterns([reverse(_cut(p))], anywhere=True) for p in patterns],
    )


def _value_length(match: bytes) -> int:
    """Of an assignment: the bytes behind the keyword, its separator and a quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    while match[at] == 32:
        at += 1
    return len(match) - at - (match[at] in b"\"'")


def _ends(automaton: Automaton, symbols: bytes, state: int = 0, at: int = 0) -> Iterator[tuple[int, int]]:
    """(end, state) of each place, from ``at`` on, where a match ends."""
    move, final = automaton.move.item, automaton.final
    for end, c in enumerate(memoryview(symbols)[at:], at + 1):
        state = move(state + c)
        if state >= final:
            yield end, state


def _last_ends(automaton: Automaton, texts: list[bytes]) -> dict[tuple[int, int], int]:
    """(text, rule) -> last end of a match, of those that have one."""
    last: dict[tuple[int, int], int] = {}

    def note(text: int, end: int, state: int) -> None:
        bits = int(automaton.accepts[state // automaton.width])
        for rule in range(len(RULES)):
            if bits >> rule & 1:
                last[text, rule] = end

    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    symbols = np.frombuffer(b"".join(texts[i] for i in order).translate(automaton.classes), np.uint8)
    place = np.cumsum(lengths) - lengths
    state, at = np.zeros(len(order), np.int32), 0
    left = len(order)
    while True:
        while left and lengths[left - 1] <= at:
            left -= 1
        if left < FEW_TEXTS:
            break
        # Steps up to where the shortest text that is left ends.
        state, place = state[:left], place[:left]
        for step in range(at, int(lengths[left - 1])):
            state = automaton.move.take(state + symbols.take(place + step))
            if state.max() >= automaton.final:
                for i in np.flatnonzero(state >= automaton.final).tolist():
                    note(order[i], step + 1, int(state[i]))
        at = int(lengths[left - 1])
    for i in range(left):
        own = texts[order[i]].translate(automaton.classes)
        for end, ended in _ends(automaton, own, int(state[i]), at):
            note(order[i], end, ended)
    return last


def _rule_matches(data: bytes, last: int, forward: Automaton, backward: Automaton) -> Iterator[tuple[int, int]]:
    begins = sorted(last - end for end, _ in _ends(backward, data[:last][::-1].translate(backward.classes)))
    symbols, move, done = data.translate(forward.classes), forward.move.item, 0
    for begin in begins:
        if begin < done:
            continue
        state, end = 0, begin
        for at in range(begin, len(symbols)):
            state = move(state + symbols[at])
            if state == forward.dead:
                break
            if state >= forward.final:
                end = at + 1
        yield begin, end
        done = end


def find_secrets(texts: list[str | None], compiled: Automata | None = None) -> list[list[tuple[str, int, int]]]:
    """Of each text (kind, start, end) in code points, by start and then in the order of the rules."""
    together, forward, backward = compiled or automata()
    datas = [(text or "").encode() for text in texts]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for (text, rule), last in _last_ends(together, datas).items():
        kind, _, least = RULES[rule]
        for a, b in _rule_matches(datas[text], last, forward[rule], backward[rule]):
            if b - a >= least and (kind != "assign" or _value_length(datas[text][a:b]) >= MIN_VALUE):
                found.setdefault(text, []).append((a, rule, b))
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for text, own in found.items():
        before, at = 0, 0
        for a, rule, b in sorted(own):
            before, at = before + len(datas[text][at:a].decode()), a
            spans[text].append((RULES[rule][0], before, before + len(datas[text][a:b].decode())))
    return spans


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, the hash of their spans, and all spans."""
    # Compiled once; a few MB, whatever the input.
    compiled = docs.sparkSession.sparkContext.broadcast(automata())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in find_secrets(batch.column(1).to_pylist(), compiled.value):
                base = [s for s in spans if s[0] in BASE]
                counts = [sum(kind == s[0] for s in base) for kind in BASE]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
