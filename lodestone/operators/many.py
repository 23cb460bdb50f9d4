"""Retrieval for a table of queries: one pass over the files for all of them.

An occurrence of a term lies within a run of identifier characters, digits or
ideographs, so the counts of a text are those of its runs.  A task finds the terms
in each distinct run once, by one automaton over the terms of all queries, and
adds the counts up; a product with the table of terms and queries gives the scores
of a batch of files for all queries.  For each query a task keeps the best ``top_k``
files and passes those on, so no pair of file and query is written or sorted but
these; the last step takes the best of what the tasks have passed on.

Queries go to the tasks with their function, ``PASS_QUERIES`` at once; a larger
table takes as many passes.  Scores count as equal where they agree in nine
decimals; ties go to the first path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.paths import is_text_file
from lodestone.operators.retrieve import BODY, DEFINITION, EXCERPT_CHARS, PATH, TOP_K, positive

PASS_QUERIES = 4096
#: Files whose scores are made at once, and bytes for the distinct runs that a task remembers.
BATCH_FILES, KNOWN_BYTES = 128, 1 << 27
#: Bytes of a remembered run besides its characters, and of each term in it.
_RUN_BYTES, _TERM_BYTES = 250, 72
DECIMALS = 9
_RUN = re.compile(r"[a-z0-9_\d\u4e00-\u9fff]+")
_DEFINED = re.compile(r"\b(?:async\s+def|def|class)\s+(?=(\w+))")


class Scorer:
    """Scores of texts for queries, each a list of terms."""

    def __init__(self, queries: list[list[str]]) -> None:
        self.n = len(queries)
        self.terms = sorted({t for q in queries for t in q})
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.users: list[list[tuple[int, int]]] = [[] for _ in self.terms]
        for i, query in enumerate(queries):
            for term, count in Counter(query).items():
                self.users[self.number[term]].append((i, count))
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            self.automaton.add_word(term, (i, len(term)))
        self.automaton.make_automaton()
        self.query = [np.array([q for q, _ in own], np.int64) for own in self.users]
        self.times = [np.array([c for _, c in own], np.float64) for own in self.users]
        self.known: dict[str, tuple] = {}
        self.known_bytes = 0

    def in_run(self, run: str) -> tuple[tuple[int, int], ...]:
        """(term, occurrences that do not overlap each other)."""
        found = self.known.get(run)
        if found is None:
            counts: dict[int, int] = {}
            free: dict[int, int] = {}
            for last, (term, size) in self.automaton.iter(run):
                start = last - size + 1
                if start >= free.get(term, 0):
                    counts[term] = counts.get(term, 0) + 1
                    free[term] = last + 1
            found = tuple(counts.items())
            size = _RUN_BYTES + len(run) + _TERM_BYTES * len(found)
            if size <= KNOWN_BYTES // 64:  # a longer one hardly comes again
                if self.known_bytes + size > KNOWN_BYTES:
                    self.known.clear()
                    self.known_bytes = 0
                self.known[run] = found
                self.known_bytes += size
        return found

    def counts(self, lowered: str) -> dict[int, int]:
        out: dict[int, int] = {}
        if not self.terms:
            return out
        for run, times in Counter(_RUN.findall(lowered)).items():
            for term, n in self.in_run(run):
                out[term] = out.get(term, 0) + times * n
        return out

    def definitions(self, lowered: str) -> dict[int, int]:
        if "def" not in lowered and "class" not in lowered:
            return {}
        names = {n for n in _DEFINED.findall(lowered) if n in self.number}
        return {self.number[n]: len(re.findall(rf"\b(?:async\s+def|def|class)\s+{re.escape(n)}\b", lowered)) for n in names}

    def scores(self, paths: list[str], texts: list[str]) -> np.ndarray:
        """A row a file, a column a query."""
        out = np.zeros((len(texts), self.n))
        for row, path, text in zip(out, paths, texts, strict=True):
            low, weights = text.lower(), {}
            for weight, counts in ((BODY, self.counts(low)), (PATH, self.counts(path.lower())), (DEFINITION, self.definitions(low))):
                for term, n in counts.items():
                    weights[term] = weights.get(term, 0.0) + weight + math.log1p(n)
            for term in sorted(weights):
                row[self.query[term]] += weights[term] * self.times[term]
        return np.round(out, DECIMALS)


class Best:
    """The best k (score, path) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least, self.held = k, np.zeros(n), [[] for _ in range(n)]

    def add(self, paths: list[str], scores: np.ndarray) -> None:
        rows, queries = np.nonzero((scores > 0) & (scores >= self.least))
        new: dict[int, list[tuple[float, str]]] = {}
        for row, q in zip(rows.tolist(), queries.tolist(), strict=True):
            new.setdefault(q, []).append((-scores[row, q], paths[row]))
        for q, found in new.items():
            own = self.held[q] = sorted(self.held[q] + found)[: self.k]
            if len(own) == self.k:
                self.least[q] = -own[-1][0]


def _best_of(files: DataFrame, queries: list[tuple], kind: str, top_k: int) -> DataFrame:
    """(query_id, path, score): what each task passes on."""
    ids, terms = [q for q, _ in queries], [T.query_terms(text) for _, text in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = Scorer(terms), Best(len(ids), top_k)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_FILES):
                paths, texts = (c.to_pylist() for c in batch.slice(at, BATCH_FILES).columns)
                best.add(paths, scorer.scores(paths, texts))
            batch = paths = texts = None  # before the next one is read
        rows = [(ids[q], path, -score) for q, own in enumerate(best.held) for score, path in own]
        if rows:
            query, path, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(path, pa.string()), pa.array(score, pa.float64())], ["query_id", "path", "score"])

    readable = files.where(is_text_file(F.col("path")) & F.col("content").isNotNull())
    return readable.select("path", "content").mapInArrow(run, f"query_id {kind}, path string, score double")


def retrieve_many(files: DataFrame, queries: DataFrame, top_k: int = TOP_K, excerpt_chars: int | None = EXCERPT_CHARS) -> DataFrame:
    """(query_id, rank, path, score, excerpt) of the best files of each of ``queries`` (query_id long or string, query).

    A query without terms, and one that no file has a term of, has no rows;
    queries of one id have to be distinct.  ``excerpt_chars=None`` leaves excerpts
    out, and with them the second read, of the files that are in the result.
    """
    positive(top_k)
    kind = "string" if queries.schema["query_id"].dataType.typeName() == "string" else "long"
    own = queries.select(F.col("query_id").cast(kind).alias("query_id"), "query").where("query_id is not null")
    passes = -(-own.count() // PASS_QUERIES)
    found = []
    for i in range(passes):
        part = own if passes == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        asked = sorted((r.query_id, r.query) for r in part.collect())
        if asked:
            found.append(_best_of(files, asked, kind, top_k))
    if not found:
        found = [_best_of(files.where("false"), [], kind, top_k)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "path", "score")
    if excerpt_chars is None:
        return ranked
    asked = own.select("query_id", T.terms(F.col("query")).alias("terms"))
    both = ranked.join(asked, "query_id").join(files.select("path", "content"), "path")
    place = T.let(F.lower("content"), lambda low: F.array_min(F.filter(F.transform("terms", lambda t: F.instr(low, t)), lambda i: i > 0)))
    start = F.coalesce(F.greatest(F.lit(0), place - 1 - excerpt_chars // 3), F.lit(0))
    return both.select("query_id", "rank", "path", "score", T.strip(F.substr("content", start + 1, F.lit(excerpt_chars))).alias("excerpt"))
