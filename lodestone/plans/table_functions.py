"""The reading tools as table functions of SQL.

``register(spark)`` adds them to a session; each takes a table of files with
``path`` and ``content`` and streams over it in tasks::

    SELECT path, line_no, line FROM grep_files(TABLE(files), '^class ') WHERE error IS NULL
    SELECT * FROM file_symbols(TABLE(files))
    SELECT * FROM best_files(TABLE(files) PARTITION BY (repo), 'parse config', 5)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank
                   FROM file_scores(TABLE(files), 'parse config')) WHERE rank <= 5

``best_files`` ranks the files of each partition by themselves and holds the best of
one partition only; all texts of a partition go to one task, so it is for many small
partitions.  ``file_scores`` takes the texts where they are and passes on the other
columns with the score, of which a task sends the best of each partition, so it is for
partitions of any size.  A call that cannot be answered, such as one with a pattern
that is no regular expression, gives rows that say why in ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.functions.paths import TEXT_SUFFIXES
from lodestone.functions.text import query_terms
from lodestone.operators.files import checked_pattern
from lodestone.operators.many import BATCH_FILES, Best, Scorer
from lodestone.operators.symbols import symbols_of

_SUFFIX = re.compile(r"^.+(\.[^.]+)$", re.DOTALL)


def _suffix(path: str) -> str:
    found = _SUFFIX.match(path.rpartition("/")[2])
    return found[1] if found else ""


def _checked_files(files: AnalyzeArgument) -> None:
    if not files.isTable or not {"path", "content"} <= set(files.dataType.names):
        raise ValueError("The first argument has to be a table with path and content.")


class GrepFiles:
    """path, line_no, line, error: the lines of text files in which Python finds a pattern."""

    @staticmethod
    def analyze(files: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        _checked_files(files)
        return AnalyzeResult(StructType().add("path", StringType()).add("line_no", IntegerType()).add("line", StringType()).add("error", StringType()))

    def __init__(self) -> None:
        self.search, self.error, self.said = None, None, False

    def eval(self, files: Row, pattern: str) -> Iterator[tuple]:
        if self.search is None and self.error is None:
            try:
                self.search = re.compile(checked_pattern(pattern)).search
            except ValueError as e:
                self.error = str(e)
        if self.error is not None:
            if not self.said:
                self.said = True
                yield None, None, None, self.error
            return
        path, content = files["path"], files["content"]
        if path is not None and content is not None and _suffix(path).lower() in TEXT_SUFFIXES:
            for i, line in enumerate(content.splitlines()):
                if self.search(line):
                    yield path, i + 1, line, None


class FileSymbols:
    """path, ord, kind, name, line: the classes and functions of Python files."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        _checked_files(files)
        return AnalyzeResult(StructType().add("path", StringType()).add("ord", IntegerType()).add("kind", StringType()).add("name", StringType()).add("line", IntegerType()))

    def eval(self, files: Row) -> Iterator[tuple]:
        path = files["path"]
        if path is not None and _suffix(path) == ".py":
            for i, (kind, name, line) in enumerate(symbols_of(files["content"] or "")):
                yield path, i, kind, name, line


class FileScores:
    """The columns of each text file that a query hits, without its content; score, error."""

    @staticmethod
    def analyze(files: AnalyzeArgument, query: AnalyzeArgument) -> AnalyzeResult:
        _checked_files(files)
        kept = [f for f in files.dataType.fields if f.name != "content"]
        if taken := {"score", "error"} & {f.name.lower() for f in kept}:
            raise ValueError(f"The table has a column of the result's name: {min(taken)}.")
        return AnalyzeResult(StructType([StructField(f.name, f.dataType) for f in kept]).add("score", DoubleType()).add("error", StringType()))

    def __init__(self) -> None:
        self.scorer = None

    def eval(self, files: Row, query: str) -> Iterator[tuple]:
        if self.scorer is None:
            self.scorer = Scorer([query_terms(query)])
        path, content = files["path"], files["content"]
        if path is not None and content is not None and _suffix(path).lower() in TEXT_SUFFIXES:
            score = float(self.scorer.scores([path], [content])[0, 0])
            if score > 0:
                yield *(files[name] for name in files.__fields__ if name != "content"), score, None


class BestFiles:
    """path, rank, score, error: the best files of a partition for a query."""

    @staticmethod
    def analyze(files: AnalyzeArgument, query: AnalyzeArgument, top_k: AnalyzeArgument) -> AnalyzeResult:
        _checked_files(files)
        return AnalyzeResult(StructType().add("path", StringType()).add("rank", IntegerType()).add("score", DoubleType()).add("error", StringType()))

    def __init__(self) -> None:
        self.scorer, self.best, self.error = None, None, None
        self.paths: list[str] = []
        self.texts: list[str] = []

    def _flush(self) -> None:
        if self.paths:
            scores = self.scorer.scores(self.paths, self.texts)
            self.best.add(self.paths, np.asarray(scores))
            self.paths, self.texts = [], []

    def eval(self, files: Row, query: str, top_k: int) -> None:
        if self.scorer is None and self.error is None:
            if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
                self.error = "top_k must be >= 1."
            else:
                self.scorer, self.best = Scorer([query_terms(query)]), Best(1, top_k)
        path, content = files["path"], files["content"]
        if self.error is None and path is not None and content is not None and _suffix(path).lower() in TEXT_SUFFIXES:
            self.paths.append(path)
            self.texts.append(content)
            if len(self.paths) >= BATCH_FILES:
                self._flush()

    def terminate(self) -> Iterator[tuple]:
        if self.error is not None:
            yield None, None, None, self.error
        elif self.scorer is not None:
            self._flush()
            for rank, (score, path) in enumerate(self.best.held[0]):
                yield path, rank + 1, -float(score), None


#: Name of a function in SQL -> its class.
FUNCTIONS = {"grep_files": GrepFiles, "file_symbols": FileSymbols, "file_scores": FileScores, "best_files": BestFiles}


def register(spark: SparkSession) -> None:
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
