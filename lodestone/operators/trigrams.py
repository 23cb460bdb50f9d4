"""A substring index of a file table: which files can hold a text, by their trigrams.

``build`` writes two tables.  ``files`` has the files as the input's partitions have
them, a folder for each ``PART_FILES`` that follow one another (``part``); texts are
read once for it and not shuffled.  ``postings`` has rows for each trigram and part,
with the numbers of the files of that part whose lower-cased path or text has it; it is
sorted by trigram, in folders by its hash (``bucket``).  Both are made by Spark
tasks: a task finds the trigrams of the files it reads, ``WINDOW_CHARS`` characters at
once, and gives a row for each trigram of these, so that what is shuffled are lists.

A search asks what its match has to contain (:mod:`lodestone.functions.regex`) and
reads the postings of the rarest trigrams of that; only parts with a file that is left
are opened.  Of these parts the files that are left are picked by a broadcast of their
numbers; more than ``LISTED_FILES`` are not, for to decide on a text takes less than to
shuffle it.  The operator itself decides in the end, so its result is that over all
files.  Where nothing is required (a text of fewer than three characters tells
nothing), all files are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import regex as R
from lodestone.functions import text as T
from lodestone.operators import files as files_ops
from lodestone.operators.retrieve import TOP_K, retrieve

#: Files of a part at most, a power of two up to 1 << 16; bytes of texts whose postings make a bucket, on average.
PART_FILES, BUCKET_BYTES = 1 << 14, 1 << 25
#: Characters whose trigrams are made at once.
WINDOW_CHARS = 1 << 21
#: Trigrams that are looked up of each required text: the rarest.
LOOKED_UP = 3
#: Looked-up trigrams that a file has, as bits of a number.
WORD_BITS = 62
#: Parts that a filter lists, and files that are picked; with more, all are opened.
LISTED_PARTS, LISTED_FILES = 10_000, 1 << 18
_FILES = "path string, content string, fid long, part long"


def trigrams_of(text: str) -> list[str]:
    return list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))


def _grams_in(rows: list[int], texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct trigrams of some texts, where the list of each begins and ends, and the numbers of the texts in them, rising."""
    sizes = np.array([len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.zeros(int(chars.max(initial=0)) + 1, bool)
    at[chars] = True
    used = np.flatnonzero(at)
    base = len(used)
    if len(texts) > 1 and base**3 * len(texts) >= 1 << 63:
        raise OverflowError
    kind = np.int32 if base**3 * len(texts) < 1 << 31 else np.int64
    code = (np.cumsum(at) - 1).astype(kind)[chars]
    text = np.repeat(np.arange(len(texts), dtype=kind), sizes)
    # One number for the three characters and the text, so that one sort brings equal ones together.
    key = ((code[:-2] * base + code[1:-1]) * base + code[2:]) * len(texts) + text[:-2]
    key = key[text[:-2] == text[2:]]
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    gram = key // len(texts)
    text = key - gram * len(texts)
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
    own = gram[first].astype(np.int64)
    all_ = used[np.stack([own // base**2, own // base % base, own % base], 1)].astype("<u4").tobytes().decode("utf-32-le")
    return [all_[i : i + 3] for i in range(0, len(all_), 3)], np.r_[first, len(gram)].astype(np.int32), np.array(rows, np.int32)[text]


def _lists(part: int, rows: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """(part, gram, rows) of some files of a part."""
    try:
        grams, ends, held = _grams_in(rows, texts)
    except OverflowError:
        # So many different characters that fewer texts fit into a number; one text always does.
        half = len(texts) // 2
        yield from _lists(part, rows[:half], texts[:half])
        yield from _lists(part, rows[half:], texts[half:])
        return
    if grams:
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), part, np.int64)), pa.array(grams, pa.string()), lists], ["part", "gram", "rows"])


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, gram, rows) of files (part, row, low): a row for each trigram of what is read at once."""
    held, rows, texts, chars = None, [], [], 0
    for batch in batches:
        for part, row, low in zip(*(c.to_pylist() if c.type != pa.string() else (v.as_py() for v in c) for c in batch.columns), strict=True):
            # A window has the first two characters of the next one, so that no trigram is cut.
            for start in range(0, len(low), WINDOW_CHARS):
                window = low[start : start + WINDOW_CHARS + 2]
                if rows and (part != held or chars + len(window) > WINDOW_CHARS):
                    yield from _lists(held, rows, texts)
                    rows, texts, chars = [], [], 0
                held = part
                rows.append(row)
                texts.append(window)
                chars += len(window)
    if rows:
        yield from _lists(held, rows, texts)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, gram, rows, n) with the list of rows as bytes, the first one and the steps to the next, modulo 1 << 16; they are shuffled and written as one value."""
    for batch in _postings_of(batches):
        part, gram, lists = batch.columns
        ends, held = lists.offsets.to_numpy(), lists.values.to_numpy()
        steps = np.diff(held, prepend=0)
        steps[ends[:-1]] = held[ends[:-1]]
        packed = pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(ends * np.int32(2)), pa.py_buffer(steps.astype("<u2"))])
        yield pa.RecordBatch.from_arrays([part, gram, packed, pa.array(np.diff(ends).astype(np.int64))], ["part", "gram", "rows", "n"])


def _unpacked(batches: Iterator[pa.RecordBatch], place: dict[str, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(part, row, word, mark) of the postings that a search reads: the place of the trigram as a bit of a word."""
    for batch in batches:
        for part, gram, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = np.cumsum(np.frombuffer(packed, "<u2"), dtype=np.uint16).astype(np.int32)
            word, bit = place[gram]
            same = [np.full(len(rows), part, np.int64), rows, np.full(len(rows), word, np.int32), np.full(len(rows), 1 << bit, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in same], ["part", "row", "word", "mark"])


def build(files: DataFrame, where: str) -> TrigramIndex:
    """Writes the index of files (path, content) to the folder ``where``."""
    # A part is what the upper bits of a file's number say, a row what the lower ones do.
    bits, size = min((PART_FILES - 1).bit_length(), 16), Observation()
    numbered = files.select("path", "content").observe(size, F.sum(F.octet_length("content")).alias("bytes")).withColumn("fid", F.monotonically_increasing_id())
    numbered.withColumn("part", F.shiftright("fid", bits)).write.partitionBy("part").parquet(f"{where}/files")
    n_buckets = 1 + (size.get.get("bytes") or 0) // BUCKET_BYTES

    stored = files.sparkSession.read.schema(_FILES).parquet(f"{where}/files")
    low = F.lower(F.concat("path", F.lit("\n"), F.coalesce("content", F.lit(""))))
    each = stored.select("part", F.col("fid").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("row"), low.alias("low"))
    postings = each.mapInArrow(_packed, "part long, gram string, rows binary, n long")
    placed = postings.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % n_buckets).cast("int"))
    placed.repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket", "gram", "part").write.partitionBy("bucket").parquet(f"{where}/postings")
    files.sparkSession.range(1).select(F.lit(n_buckets).alias("n_buckets"), F.lit(bits).alias("bits")).write.parquet(f"{where}/about")
    return TrigramIndex(files.sparkSession, where)


@dataclass(frozen=True)
class TrigramIndex:
    """An index that :func:`build` has written."""

    spark: SparkSession
    where: str

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.where}/{table}")

    @cached_property
    def files(self) -> DataFrame:
        """All files: path, content, fid, part."""
        return self._read("files", _FILES)

    @cached_property
    def _about(self) -> tuple[int, int]:
        """Buckets of postings; bits of a file's number that tell it from others of its part."""
        return tuple(self._read("about", "n_buckets int, bits int").first())

    @cached_property
    def _all_postings(self) -> DataFrame:
        return self._read("postings", "gram string, part long, rows binary, n long, bucket int")

    def _postings(self, grams: list[str]) -> DataFrame:
        buckets = {zlib.crc32(g.encode()) % self._about[0] for g in grams}
        return self._all_postings.where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*grams))

    def candidates(self, need: R.Requirement) -> DataFrame | None:
        """(part, fid) of the files that can hold what is needed; None if that says nothing."""
        texts = _texts(need)
        if not _tells(need):
            return None
        grams = sorted({g for t in texts for g in trigrams_of(t)})
        counts = {r.gram: r.n for r in self._postings(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        chosen = {t: sorted(trigrams_of(t), key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP] for t in texts}
        wanted = sorted({g for own in chosen.values() for g in own if g in counts})
        if not wanted:
            return self.files.where("false").select("part", "fid")
        place = {g: divmod(i, WORD_BITS) for i, g in enumerate(wanted)}
        rows = self._postings(wanted).select("part", "gram", "rows").mapInArrow(lambda batches: _unpacked(batches, place), "part long, row int, word int, mark long")
        words = [F.bit_or(F.when(F.col("word") == k, F.col("mark")).otherwise(F.lit(0))).alias(f"w{k}") for k in sorted({word for word, _ in place.values()})]
        held = rows.groupBy("part", "row").agg(*words).where(_holds(place, need, chosen))
        return held.select("part", F.shiftleft("part", self._about[1]).bitwiseOR(F.col("row")).alias("fid"))

    def holding(self, need: R.Requirement) -> DataFrame:
        """(path, content) of the files that can hold what is needed, reading no part without one."""
        found = self.candidates(need)
        if found is None:
            return self.files.select("path", "content")
        parts = {r.part: r.n for r in found.groupBy("part").agg(F.count("*").alias("n")).limit(LISTED_PARTS + 1).collect()}
        if len(parts) > LISTED_PARTS:
            return self.files.select("path", "content")
        stored = self.files.where(F.col("part").isin(*parts) if parts else F.lit(False))
        if sum(parts.values()) <= LISTED_FILES:
            stored = stored.join(F.broadcast(found.select("fid")), "fid", "left_semi")
        return stored.select("path", "content")

    def grep(self, pattern: str) -> DataFrame:
        """The rows of ``files.grep`` over all files."""
        return files_ops.grep(self.holding(R.required(files_ops.checked_pattern(pattern))), pattern)

    def retrieve(self, query: str, top_k: int = TOP_K) -> DataFrame:
        """The rows of ``retrieve`` over all files: a score above zero takes a term in the text or the path."""
        terms = list(dict.fromkeys(T.query_terms(query)))
        return retrieve(self.holding(("any", terms) if terms else None), query, top_k)


def _texts(need: R.Requirement) -> list[str]:
    """The required texts that have a trigram."""
    if need is None or isinstance(need, str):
        return [need] if need and len(need) >= 3 else []
    return [t for part in need[1] for t in _texts(part)]


def _tells(need: R.Requirement) -> bool:
    if need is None or isinstance(need, str):
        return bool(need) and len(need) >= 3
    return (any if need[0] == "all" else all)(map(_tells, need[1]))


def _holds(place: dict[str, tuple[int, int]], need: R.Requirement, chosen: dict[str, list[str]]) -> Column:
    """Whether a file with these of the looked-up trigrams can hold what is needed."""
    if need is None or isinstance(need, str):
        out = F.lit(True)
        for g in chosen.get(need or "", []):
            word, bit = place.get(g, (0, 0))
            out = out & (F.col(f"w{word}").bitwiseAND(F.lit(1 << bit)) != 0) if g in place else F.lit(False)
        return out
    each = [_holds(place, part, chosen) for part in need[1]]
    out = each[0]
    for more in each[1:]:
        out = out & more if need[0] == "all" else out | more
    return out
