"""All sections of a snapshot from one scan of the files.

Each task feeds five bounded accumulators: the first paths with their previews,
the first symbols, the best files of the query, the rules files, and the number of
files.  They merge by key in two steps, the first in several tasks, so a task gets
no more than the accumulators of its share of the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.paths import is_text_file, suffix
from lodestone.operators import files as files_ops
from lodestone.operators.retrieve import EXCERPT_CHARS, NO_FILES, NO_TERMS, score
from lodestone.operators.symbols import SYMBOL_ROWS, symbols_of

MERGE_TASKS = 16
NO_SYMBOLS = "No Python symbols found."
NO_PREVIEWS = "No text file previews available."
EMPTY = "(empty repository)"
_PARTS = [("kind", pa.string()), ("key", pa.float64()), ("path", pa.string()), ("ord", pa.int32()), ("text", pa.string()), ("n", pa.int64())]
_PARTS_SQL = "kind string, key double, path string, ord int, text string, n long"


class Least:
    """The first ``cap`` entries by (key, path, ord)."""

    def __init__(self, cap: int) -> None:
        self.cap, self.rows, self.last = cap, [], None

    def takes(self, key: float, path: str) -> bool:
        return self.last is None or (key, path) <= self.last

    def add(self, key: float, path: str, order: int, text: str | None) -> None:
        if self.takes(key, path):
            self.rows.append((key, path, order, text))
            if len(self.rows) >= 4 * self.cap:
                self.first()
                self.last = self.rows[-1][:2]

    def first(self) -> list[tuple]:
        self.rows = sorted(self.rows, key=lambda r: r[:3])[: self.cap]
        return self.rows


class Accumulators:
    def __init__(self, max_files: int, top_k: int) -> None:
        self.kinds = {"path": Least(max_files), "symbol": Least(SYMBOL_ROWS), "hit": Least(top_k), "rule": Least(len(files_ops.RULE_FILES))}
        self.n = 0

    def file(self, path: str, preview: str | None, source: str | None, rule: int | None, rules: str | None, points: float | None, excerpt: str | None) -> None:
        self.n += 1
        self.kinds["path"].add(0.0, path, 0, preview)
        if source is not None and self.kinds["symbol"].takes(0.0, path):
            for i, (kind, name, line) in enumerate(symbols_of(source)):
                self.kinds["symbol"].add(0.0, path, i, f"{path}:{line}: {kind} {name}")
        if points:
            self.kinds["hit"].add(-points, path, 0, excerpt)
        if rule:
            # Files without a text come behind all that have one.
            self.kinds["rule"].add(rule + (100.0 if rules is None else 0.0), path, 0, rules)

    def merge(self, rows: Iterable[dict]) -> None:
        for r in rows:
            if r["kind"] == "count":
                self.n += r["n"]
            else:
                self.kinds[r["kind"]].add(r["key"], r["path"], r["ord"], r["text"])

    def batch(self) -> pa.RecordBatch:
        rows = [(kind, *r, 0) for kind, own in self.kinds.items() for r in own.first()] + [("count", 0.0, "", 0, None, self.n)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PARTS, strict=True)], [n for n, _ in _PARTS])

    def sections(self, without_query: str | None) -> dict[str, str]:
        """The texts of the sections; ``without_query`` stands for the notes where nothing was asked."""
        paths, hits, rules = (self.kinds[k].first() for k in ("path", "hit", "rule"))
        notes = [f"## {path} score={-key:.2f}\n```\n{text}\n```" for key, path, _, text in hits]
        blocks = [f"## {path}\n```\n{text}\n```" for _, path, _, text in paths if text]
        known = [text for _, _, _, text in rules if text is not None]
        return {
            "tree": self._tree([path for _, path, _, _ in paths]),
            "symbols": "\n".join(text for *_, text in self.kinds["symbol"].first()) or NO_SYMBOLS,
            "notes": without_query or "\n\n".join(notes) or NO_FILES,
            "rules": known[0] if known else files_ops.RULES_UNREADABLE if rules else files_ops.NO_RULES,
            "previews": "\n\n".join(blocks) or NO_PREVIEWS,
        }

    def _tree(self, paths: list[str]) -> str:
        lines, seen = [], set()
        for path in paths:
            parts = path.split("/")
            for depth in range(len(parts) - 1):
                folder = tuple(parts[: depth + 1])
                if folder not in seen:
                    seen.add(folder)
                    lines.append(f"{'  ' * depth}- {parts[depth]}/")
            lines.append(f"{'  ' * (len(parts) - 1)}- {parts[-1]}")
        if self.n > len(paths):
            lines.append(f"... {self.n - len(paths)} more files omitted")
        return "\n".join(lines) or EMPTY


def sections(files: DataFrame, query: str | None, without_query: str, names: list[str], top_k: int, max_files: int, preview_chars: int) -> DataFrame:
    """(ord, section, output) of ``names``; ``without_query`` is what the notes say where ``query`` is None."""
    terms = T.query_terms(query)
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    readable = is_text_file(path) & F.col("content").isNotNull()
    points = F.when(readable, score(terms, path, F.col("content"))) if terms else F.lit(None).cast("double")
    rank = F.array_position(F.array(*[F.lit(n) for n in files_ops.RULE_FILES]), path)
    scored = files.select("path", "content", points.alias("points"))
    excerpt = F.when(F.col("points") > 0, T.excerpt(F.col("content"), terms, EXCERPT_CHARS)) if terms else F.lit(None).cast("string")
    rows = scored.select(
        "path",
        F.when(is_text_file(path), T.preview(content, preview_chars)).alias("preview"),
        F.when(suffix(path) == ".py", content).alias("source"),
        F.nullif(rank, F.lit(0)).alias("rule"),
        F.when(rank > 0, F.col("content")).alias("rules"),
        "points",
        excerpt.alias("excerpt"),
    )
    said = without_query if query is None else None if terms else NO_TERMS

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Accumulators(max_files, top_k)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.file(*row)
        yield own.batch()

    def merged(batches: Iterator[pa.RecordBatch]) -> Accumulators:
        own = Accumulators(max_files, top_k)
        for batch in batches:
            own.merge(batch.to_pylist())
        return own

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield merged(batches).batch()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = merged(batches).sections(said)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(names), pa.array([found[n] for n in names])], ["ord", "section", "output"])

    shared = rows.mapInArrow(collect, _PARTS_SQL).repartition(MERGE_TASKS).mapInArrow(merge, _PARTS_SQL)
    return shared.repartition(1).mapInArrow(render, "ord int, section string, output string")
