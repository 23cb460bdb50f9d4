"""Python symbols: classes and functions of source files, found by the ``ast`` module in tasks."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import suffix
from lodestone.operators.retrieve import joined

#: Fixed value: rows of a report.
SYMBOL_ROWS = 120
SCHEMA = "path string, ord int, kind string, name string, line int"


def symbols_of(source: str) -> Iterator[tuple[str, str, int]]:
    """(kind, name, line) in breadth-first order; nothing of a file that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
    for node in ast.walk(tree):
        if type(node) in kinds:
            yield kinds[type(node)], node.name, node.lineno


def symbols(files: DataFrame) -> DataFrame:
    """(path, ord, kind, name, line) of each symbol of the ``.py`` files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32())])
        for batch in batches:
            rows = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{"path": path, "ord": i, "kind": k, "name": n, "line": at} for i, (k, n, at) in enumerate(symbols_of(source or ""))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where(suffix(F.col("path")) == ".py").select("path", "content").mapInArrow(run, SCHEMA)


def symbol_report(files: DataFrame, cap: int = SYMBOL_ROWS) -> DataFrame:
    first = symbols(files).orderBy("path", "ord").limit(cap)
    return joined(first, ["path", "ord"], F.format_string("%s:%d: %s %s", "path", "line", "kind", "name"), "\n", "No Python symbols found.")
