"""A file tree, indexed: outline, previews, rules, symbols and retrieval as DataFrames of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import files as files_ops
from lodestone.operators.retrieve import TOP_K, joined, positive, retrieval_notes
from lodestone.plans.one_pass import sections
from lodestone.sources.repo import scan_repo

#: Titles of the sections of a snapshot, and what stands for a missing query.
SECTIONS = {"tree": "Repository tree", "symbols": "Symbol index", "notes": "Retrieval notes", "rules": "Project rules", "previews": "Important file previews"}
CONTEXT = ("tree", "symbols", "notes", "previews")
NO_QUERY = "No task-specific retrieval query provided."


def snapshot(files: DataFrame, query: str | None = None, top_k: int = TOP_K, max_files: int = files_ops.TREE_FILES, preview_chars: int = files_ops.PREVIEW_CHARS) -> DataFrame:
    """(ord, section, output): a row for each section, from one scan of the files."""
    return sections(files, query, NO_QUERY, list(SECTIONS), positive(top_k), positive(max_files), preview_chars)


def as_context(sections: DataFrame) -> DataFrame:
    """A snapshot as one text, without the rules."""
    titles = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    text = F.concat(F.lit("# "), titles[F.col("section")], F.lit("\n"), F.col("output"))
    return joined(sections.where(F.col("section").isin(*CONTEXT)), ["ord"], text, "\n\n", "").select(F.concat("output", F.lit("\n")).alias("output"))


class RepoIndex:
    """The operators over one local tree."""

    def __init__(self, spark: SparkSession, root: str, max_files: int = files_ops.TREE_FILES, preview_chars: int = files_ops.PREVIEW_CHARS, skip: Column | None = None) -> None:
        self.files = scan_repo(spark, root, skip)
        self.max_files, self.preview_chars = max_files, preview_chars

    def snapshot(self, query: str | None = None, top_k: int = TOP_K) -> dict[str, str]:
        rows = snapshot(self.files, query, top_k, self.max_files, self.preview_chars).collect()
        return {r.section: r.output for r in rows}

    def retrieve(self, query: str | None, top_k: int = TOP_K) -> str:
        return retrieval_notes(self.files, query, top_k).first().output
