"""Edits as functional updates: a DataFrame of files in, statuses, new contents and diffs out.

Nothing is changed in place; the new contents are written as a new table, or by
the caller.  An edit is a row (path, old, new) or (path, content).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.text import occurrences


@F.pandas_udf(StringType())
def _diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    def one(p, a, b):
        return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), fromfile=f"a/{p}", tofile=f"b/{p}", lineterm=""))

    return pd.Series([one(*x) for x in zip(path, old, new, strict=True)], dtype=object)


def unified_diff(path: Column, old: Column, new: Column) -> Column:
    """The unified diff of two texts; empty if they have the same lines."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.when(blank(old) == blank(new), F.lit("")).otherwise(_diff(path, blank(old), blank(new)))


def replacement_error(content: Column, old: Column) -> Column:
    """Why exactly one occurrence cannot be replaced, or null."""
    n = occurrences(content, old)
    return (
        F.when(old.isNull(), F.lit("replace_in_file requires string old and new fields."))
        .when(old == "", F.lit("replace_in_file requires a non-empty old snippet."))
        .when(n == 0, F.lit("old text not found; inspect the file before retrying."))
        .when(n > 1, F.concat(F.lit("old text occurs "), n.cast("string"), F.lit(" times; provide a more specific snippet.")))
    )


def replace_once(files: DataFrame, old: Column, new: Column) -> DataFrame:
    """(path, ok, error, content): each file with its single occurrence of ``old`` replaced."""
    content = F.coalesce("content", F.lit(""))
    error = F.when(new.isNull(), F.lit("replace_in_file requires string old and new fields.")).otherwise(replacement_error(content, old))
    judged = files.select("path", content.alias("before"), error.alias("error"), F.replace(content, old, new).alias("after"))
    return judged.select("path", F.col("error").isNull().alias("ok"), "error", F.when(F.col("error").isNull(), F.col("after")).otherwise(F.col("before")).alias("content"))


def _reported(rows: DataFrame, done: str) -> DataFrame:
    diff = unified_diff(F.col("path"), F.col("before"), F.col("after"))
    rows = rows.withColumn("diff", F.when(F.col("error").isNull(), diff))
    message = F.when(F.col("diff") == "", F.concat(F.lit(f"{done} "), "path", F.lit(" with no textual diff."))).otherwise(F.col("diff"))
    return rows.select("path", F.col("error").isNull().alias("ok"), F.coalesce("error", message).alias("output"), F.when(F.col("error").isNull(), F.col("after")).otherwise(F.col("before")).alias("content"))


def apply_replacements(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, ok, output, content) for edits (path, old, new); one edit a path."""
    content = F.coalesce("content", F.lit(""))
    both = edits.select("path", "old", "new").join(files.select("path", "content"), "path", "left")
    error = (
        F.when(F.col("old").isNull() | F.col("new").isNull(), F.lit("replace_in_file requires string old and new fields."))
        .when(F.col("old") == "", F.lit("replace_in_file requires a non-empty old snippet."))
        .when(F.col("content").isNull(), F.concat(F.lit("File not found: "), F.col("path")))
        .otherwise(replacement_error(content, F.col("old")))
    )
    after = F.when(F.col("old") != "", F.replace(content, F.col("old"), F.col("new")))
    return _reported(both.select("path", content.alias("before"), error.alias("error"), after.alias("after")), "Updated")


def apply_writes(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, ok, output, content) for edits (path, content) that overwrite or create files."""
    written = edits.select("path", F.col("content").alias("after"))
    both = written.join(files.select("path", F.col("content").alias("before")), "path", "left")
    error = F.when(F.col("after").isNull(), F.lit("write_file requires string content."))
    return _reported(both.select("path", F.coalesce("before", F.lit("")).alias("before"), "after", error.alias("error")), "Wrote")


def updated_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """The file table after edits: changed contents, and files that are new."""
    changed = results.where("ok").select("path", F.col("content").alias("new_content"))
    return files.select("path", "content").join(changed, "path", "full").select("path", F.coalesce("new_content", "content").alias("content"))
