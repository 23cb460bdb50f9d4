"""Listing, reading, searching and outlining files; all take a DataFrame with ``path`` and ``content``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import regex as R
from lodestone.functions import text as T
from lodestone.functions.paths import is_below, is_text_file, name, parts, skipped
from lodestone.operators.retrieve import joined, positive

# How many rows a report shows, and its messages.
LIST_ROWS, GREP_ROWS, TREE_FILES, PREVIEW_CHARS, READ_CHARS = 120, 80, 80, 1200, 12_000
RULE_FILES = ("AGENT.md", "CLAUDE.md")
#: Files of the first batch of a search that stops early, and of the largest.
FIRST_FILES, MOST_FILES = 64, 4096
NO_RULES = "No project-specific AGENT.md or CLAUDE.md found. Follow safe minimal-change defaults."
UNREADABLE = "File could not be read: "
RULES_UNREADABLE = "Project rules file exists but could not be read. Follow safe minimal-change defaults."


def visible(files: DataFrame, base: str = ".") -> DataFrame:
    """The files below a base that tools may show."""
    link = F.col("is_symlink") if "is_symlink" in files.columns else None
    return files.where(is_below(F.col("path"), base) & ~skipped(F.col("path"), link))


def _capped(rows: DataFrame, order: list, text, cap: int, marker: str, empty: str) -> DataFrame:
    """The first rows as one text; the marker follows as soon as the cap is reached."""
    return joined(rows.orderBy(*order).limit(cap), order, text, "\n", empty, cap, marker)


def list_report(files: DataFrame, base: str = ".", cap: int = LIST_ROWS) -> DataFrame:
    """Paths in order of their components, as one text."""
    rows = visible(files, base).select(parts(F.col("path")).alias("p"), "path")
    return _capped(rows, ["p"], F.col("path"), cap, "... output truncated", "No files found.")


def read_text(files: DataFrame, limit: int = READ_CHARS) -> DataFrame:
    """(path, output): contents cut at ``limit`` characters."""
    positive(limit, "read_file limit must be a positive integer.")
    return files.select("path", T.truncated(F.coalesce("content", F.lit("")), limit, "\n... file truncated").alias("output"))


def checked_pattern(pattern: object) -> str:
    """A regex that is known to compile before a job starts."""
    if not isinstance(pattern, str) or not pattern:
        raise ValueError("grep requires a non-empty pattern.")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"Invalid regex: {e}") from e
    return pattern


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line_no, line) of the lines of text files in which Python's ``re.search`` finds the pattern.

    Texts without what a match has to contain are left out before they are cut.
    """
    requirement = R.required(checked_pattern(pattern))
    texts = files.where(is_text_file(F.col("path")))
    if requirement is not None:
        texts = texts.where(R.may_match(F.lower("content"), requirement))
    each = texts.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "line"))
    return each.where(R.searched(F.col("line"), pattern)).select("path", (F.col("i") + 1).alias("line_no"), "line")


def first_hits(files: DataFrame, pattern: str, cap: int, names: DataFrame | None = None) -> list:
    """The first rows (p, line_no, path, line) of :func:`grep` in order of the components of paths, ``cap`` at most.

    Files are searched in batches in that order, each larger than the one before,
    until there are enough rows: a report of a few lines reads a few files, where
    most have a hit.  What follows ``MOST_FILES`` files is searched at once.  ``names`` has
    the paths, where reading ``files`` for them would read contents too.
    """
    order = parts(F.col("path"))
    left = (files if names is None else names).where(is_text_file(F.col("path"))).select(order.alias("p"), "path")
    found, after, size = [], None, FIRST_FILES

    def hits(some: DataFrame) -> list:
        return grep(some, pattern).select(order.alias("p"), "line_no", "path", "line").orderBy("p", "line_no").limit(cap - len(found)).collect()

    while len(found) < cap:
        rest = left if after is None else left.where(F.col("p") > after)
        if size > MOST_FILES:
            return found + hits(files if after is None else files.where(order > after))
        batch = rest.orderBy("p").limit(size).collect()
        if not batch:
            break
        found += hits(files.where(F.col("path").isin(*{r.path for r in batch})))
        after = F.array(*[F.lit(x) for x in batch[-1].p])
        if len(batch) < size:
            break
        size *= 4
    return found


def grep_report(files: DataFrame, pattern: str, base: str = ".", cap: int = GREP_ROWS, names: DataFrame | None = None) -> DataFrame:
    """The first lines that match, as one text; see :func:`first_hits`."""
    checked_pattern(pattern)
    rows = first_hits(visible(files, base), pattern, cap, None if names is None else visible(names, base))
    few = files.sparkSession.createDataFrame([tuple(r) for r in rows], "p array<string>, line_no int, path string, line string")
    return joined(few, ["p", "line_no"], F.format_string("%s:%d: %s", "path", "line_no", "line"), "\n", "No matches found.", cap, "... matches truncated")


def previews(files: DataFrame, chars: int = PREVIEW_CHARS) -> DataFrame:
    """(path, preview) of text files; blank previews are left out."""
    return files.where(is_text_file(F.col("path"))).select("path", T.preview(F.coalesce("content", F.lit("")), chars).alias("preview")).where("preview <> ''")


def preview_report(files: DataFrame, max_files: int = TREE_FILES, chars: int = PREVIEW_CHARS) -> DataFrame:
    first = files.select("path", "content").orderBy("path").limit(max_files)
    return joined(previews(first, chars), ["path"], F.format_string("## %s\n```\n%s\n```", "path", "preview"), "\n\n", "No text file previews available.")


def tree_lines(files: DataFrame) -> DataFrame:
    """(first_path, depth, line): each directory once, before its first file, and each file."""
    p = parts(F.col("path"))
    dirs = files.select("path", F.posexplode(F.slice(p, 1, F.size(p) - 1)).alias("depth", "part"), p.alias("p"))
    once = dirs.groupBy(F.slice("p", F.lit(1), F.col("depth") + 1).alias("dir")).agg(F.min("path").alias("first_path"))
    depth = F.size("dir") - 1
    folders = once.select("first_path", depth.alias("depth"), F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), F.element_at("dir", -1), F.lit("/")).alias("line"))
    leaves = files.select(F.col("path").alias("first_path"), (F.size(p) - 1).alias("depth"), F.concat(F.repeat(F.lit("  "), F.size(p) - 1), F.lit("- "), name(F.col("path"))).alias("line"))
    return folders.union(leaves)


def tree_report(files: DataFrame, max_files: int = TREE_FILES) -> DataFrame:
    first = files.select("path").orderBy("path").limit(max_files)
    left = files.agg((F.count("*") - max_files).alias("more"))
    both = tree_lines(first).withColumn("more", F.lit(None).cast("long")).unionByName(left, allowMissingColumns=True)
    placed = F.when(F.col("line").isNotNull(), F.struct("first_path", "depth", "line"))
    one = both.agg(F.array_join(F.sort_array(F.collect_list(placed))["line"], "\n").alias("tree"), F.max("more").alias("more"))
    omitted = F.when(F.col("more") > 0, F.concat(F.lit("\n... "), F.col("more").cast("string"), F.lit(" more files omitted"))).otherwise(F.lit(""))
    return one.select(F.when(F.col("tree") == "", F.lit("(empty repository)")).otherwise(F.concat("tree", omitted)).alias("output"))


def rules_report(files: DataFrame) -> DataFrame:
    """The text of the first rules file at the root that has one.

    A file whose content is null is one that could not be read.
    """
    rank = F.array_position(F.array(*[F.lit(n) for n in RULE_FILES]), F.col("path"))
    found = files.where(F.col("path").isin(*RULE_FILES)).agg(F.min_by("content", F.when(F.col("content").isNotNull(), rank)).alias("rules"), F.count("*").alias("n"))
    return found.select(F.coalesce("rules", F.when(F.col("n") > 0, F.lit(RULES_UNREADABLE)), F.lit(NO_RULES)).alias("output"))
