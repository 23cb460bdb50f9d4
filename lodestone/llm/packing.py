"""Operator 11: packing of documents into windows by the sum-of-squares rule.

A document is its token ids and an end id.  Full windows of a document longer than
a window leave at once; its last piece, and every shorter document, is placed
whole and online: of the fill levels with an open window that it fits into, and
of a new window, that level is taken for which the sum over all levels of the
squared number of open windows is least afterwards (Csirik et al., "On the
Sum-of-Squares Algorithm for Bin Packing", 2006); ties go to the fullest.  The
numbers of open windows are kept in one array over the levels, so a placement
is one expression over that array, whatever number of windows is open.

A window that lacks ``SPARE`` ids at most counts as full; what it lacks is all the
padding there is.  A task packs the rows it reads, as they come, so nothing is
shuffled and no key can be hot.  It holds the pieces of its open windows only,
``OPEN_WINDOWS`` at most.  What is open when there are more, or when the task ends,
is closed: its pieces, from the fullest window to the emptiest, are laid end to
end and cut anew at every window, and what is left at the very end is cut at
powers of two, as a window that is one needs no padding.  So only pieces of
windows that did not fill up are cut, next to documents longer than a window.

Ids are those of the tokenizer for the whole text.  Where the tokenizer treats the
parts between white space each by itself, a task encodes each distinct part once
and keeps what it found, ``CACHED`` of a kind at most.

Defined results: null text is empty, and has the end id alone; repeated rows and
ids, and null ids, are documents of their own; an empty table gives an empty
result; texts of any length are cut into parts, and one part without white space
is encoded whole.  Only ``doc_id`` and ``text`` are read.  Numbers of sequences are
unique in a result and made of the number of the task's input partition; a rerun
over the same input partitions gives the same rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
#: Ids that a window may lack and yet counts as full: its padding.
SPARE = 16
OPEN_WINDOWS = 2048
CACHED = 1_000_000
#: Longer parts are encoded but not kept.
KEPT_CHARS = 64
#: Patterns of tokenizers that treat the parts between white space each by itself, after NFC and lower case of single characters.
APART = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Parts that NFC leaves as they are and whose characters have one lower case each, in any context: Latin ones without white space and without U+0130.
PLAIN = r"^[\x{21}-\x{7e}\x{a1}-\x{12f}\x{131}-\x{24f}]+$"
LETTERS = r"^\pL+$"
#: Pieces of an Arrow batch, and the bytes of ids in one.
OUT_PIECES, OUT_BYTES = 4096, 16 << 20
#: Bytes of text whose parts are encoded together (one text at least).
TOGETHER = 16 << 20
_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers; parts that were seen are not encoded again.

    Where the tokenizer drops white space (its pattern is in ``APART``), a text is
    cut there.  A part of Latin letters, digits and marks is cut on into the
    pieces that the tokenizer's own pattern makes of it in lower case, so that a
    word is encoded once for all its cases and punctuation; any other part is
    left to the tokenizer.  Texts go to any other tokenizer whole.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        steps = [step.get("type") for step in (config.get("normalizer") or {}).get("normalizers", [])]
        split = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        found = (split.get("pattern") or {}).get("Regex")
        self.apart = found in APART and split.get("behavior") == "Removed" and steps == ["NFC", "Replace", "Lowercase"] and bool(config["model"].get("end_of_word_suffix"))
        self.pattern = found
        suffix = config["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.end = np.array([end_id], "<u4").tobytes()
        self.seen: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, new: list[str]) -> list[bytes]:
        """Encodes pieces in one text; each ends with the one id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in pairwise([0, *stops])]

    def known(self, cache: dict[str, bytes], texts: list[str], add) -> pa.Array:
        """The ids of distinct texts, those that are new from ``add``; texts that are long are not kept."""
        new = [t for t in texts if t not in cache]
        if len(cache) + len(new) > CACHED:
            cache.clear()
            new = texts
        if new:
            cache.update(zip(new, add(new), strict=True))
        ids = pa.array([cache[t] for t in texts], pa.large_binary())
        for t in new:
            if len(t) > KEPT_CHARS:
                cache.pop(t, None)
        return ids

    def of_parts(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids, and for each part of distinct ones the place of its ids."""
        short = pc.less_equal(pc.utf8_length(parts), KEPT_CHARS)
        plain = pc.and_(pc.and_(short, pc.match_substring_regex(parts, PLAIN)), pc.invert(pc.match_substring(parts, "<|")))
        letters = pc.and_(plain, pc.match_substring_regex(parts, LETTERS))
        mixed = pc.and_not(plain, letters)
        # A part of letters is one piece; others are cut as the pattern says.
        words = pc.utf8_lower(parts.filter(letters))
        cut = pc.replace_substring_regex(pc.utf8_lower(parts.filter(mixed)), f"({self.pattern})", r"\1 ")
        pieces = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(cut))
        coded = pa.concat_arrays([words, pieces.flatten()]).dictionary_encode()
        own = self.known(self.pieces, coded.dictionary.to_pylist(), self.of_pieces).take(coded.indices)
        rest = self.known(self.seen, parts.filter(pc.invert(plain)).to_pylist(), self.whole)
        place, done = np.empty(len(parts), np.int64), 0
        for group in (letters, mixed, pc.invert(plain)):
            at = np.flatnonzero(group.to_numpy(zero_copy_only=False))
            place[at] = np.arange(done, done + len(at))
            done += len(at)
        return pa.concat_arrays([own[: len(words)], _merged(own[len(words) :], pieces.offsets.to_numpy()), rest]), place

    def documents(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, and the end id."""
        texts = texts.fill_null("")
        if not self.apart:
            yield from (ids + self.end for ids in self.whole(texts.to_pylist()))
            return
        # ASCII white space; each distinct part of the batch is looked up once.
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, place = self.of_parts(coded.dictionary)
        each = _merged(ids.take(pa.array(place[coded.indices.to_numpy()])), split.offsets.to_numpy())
        for own in each:
            yield own.as_py() + self.end


def _merged(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    """Binary values joined by lists that ``offsets`` says the lengths of."""
    if not len(values):
        return pa.array([b""] * (len(offsets) - 1), pa.large_binary())
    _, bounds, data = values.buffers()
    at = np.frombuffer(bounds, np.int64)[values.offset : values.offset + len(values) + 1][offsets - offsets[0]]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), data])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One of each kind in a worker."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


@dataclass(frozen=True)
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[4 * at :], self.doc_tokens)


@dataclass
class Packer:
    """Open windows by level, and the array of their numbers."""

    window: int = WINDOW
    most_open: int = OPEN_WINDOWS
    spare: int = SPARE
    counts: np.ndarray = field(init=False)
    open: dict[int, list[list[Piece]]] = field(default_factory=dict)
    n_open: int = 0

    def __post_init__(self) -> None:
        self.counts = np.zeros(self.window + 1, np.int64)

    def level_for(self, size: int) -> int:
        """The level that a piece of ``size`` goes to; 0 is a new window."""
        counts = self.counts
        levels = self.window - size + 1
        # (n + 1)^2 - n^2 where the piece comes to, (n - 1)^2 - n^2 where it leaves; full and new windows are no level.
        change = 2 * counts[size : size + levels] + 1
        change[-1 - self.spare :] = 0
        change[1:] += 1 - 2 * counts[1:levels]
        impossible = counts[:levels] == 0
        impossible[0] = False
        change[impossible] = np.iinfo(np.int64).max
        # The last of the least ones.
        return int(levels - 1 - change[::-1].argmin())

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece of a window's size at most; yields what is complete then."""
        level = self.level_for(len(piece))
        own: list[Piece] = []
        if level:
            own = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        own.append(piece)
        level += len(piece)
        if level >= self.window - self.spare:
            yield own
            return
        self.open.setdefault(level, []).append(own)
        self.counts[level] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """Closes all open windows anew; each that is yielded has the window's size or a power of two of ids."""
        held: list[Piece] = [p for level in sorted(self.open, reverse=True) for own in self.open[level] for p in own]
        total = sum(map(len, held))
        sizes = [self.window] * (total // self.window) + [1 << b for b in range(self.window.bit_length() - 1, -1, -1) if total % self.window >> b & 1]
        held.reverse()
        for size in sizes:
            own, left = [], size
            while left:
                piece = held.pop()
                if len(piece) > left:
                    piece, rest = piece.cut(left)
                    held.append(rest)
                own.append(piece)
                left -= len(piece)
            yield own
        self.counts[:] = 0
        self.open, self.n_open = {}, 0

    def document(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        n = len(ids) // 4
        step = 4 * self.window
        for at in range(0, len(ids) - step + 1, step):
            yield [Piece(doc_id, at // 4, ids[at : at + step], n)]
        if n % self.window:
            at = n - n % self.window
            yield from self.place(Piece(doc_id, at, ids[4 * at :], n))


def of_bytes(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices with texts of about ``most`` bytes together, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at, done = stop, int(sizes[stop - 1])


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, most_open: int = OPEN_WINDOWS, spare: int = SPARE) -> DataFrame:
    """A row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    names = [part.split()[0] for part in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer, end_id), Packer(window, most_open, spare)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32

        def sequences() -> Iterator[list[Piece]]:
            for batch in batches:
                for part in of_bytes(batch, TOGETHER):
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode.documents(part.column(1)), strict=True):
                        yield from packer.document(doc_id, ids)
            yield from packer.close()

        rows: list[tuple] = []
        size = 0
        for nth, own in enumerate(sequences()):
            offset = 0
            for p in own:
                rows.append((p.doc_id, p.start, len(p), p.ids, p.doc_tokens, number + nth, offset))
                offset += len(p)
                size += len(p.ids)
            if len(rows) >= OUT_PIECES or size >= OUT_BYTES:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row a sequence: sequence_id, ids of its pieces, the lengths of the pieces (for attention that stays within a document), padding.

    ``padding`` is what fills the sequence up to the window; 0 at a power of two.
    A group has a window of ids at most.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    each = pieces.groupBy("sequence_id").agg(ordered.alias("p"), F.sum("length").alias("length"))
    ids = F.aggregate("p.ids", F.lit(b""), lambda acc, b: F.concat(acc, b))
    padding = F.when(F.bit_count("length") == 1, F.lit(0).cast("long")).otherwise(window - F.col("length"))
    return each.select("sequence_id", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"), "length", padding.alias("padding"))
