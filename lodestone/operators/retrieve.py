"""Lexical retrieval: weighted scoring of files against a query, top k and excerpts.

Files are any DataFrame with ``path`` and ``content``.  A score is one pass over
the texts; the top k leave each task, so a corpus of any size sends k rows a
task.  Zero scores are dropped after the limit, which the order allows, and
excerpts are cut for the k rows alone.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.paths import is_text_file

# Weights of a hit in the text, in the path and in a definition; sizes; messages.
BODY, PATH, DEFINITION = 1.0, 3.0, 4.0
TOP_K, TOOL_TOP_K, EXCERPT_CHARS = 8, 5, 1400
NO_TERMS = "No retrieval query terms available."
NO_FILES = "No relevant files found by lexical retrieval. Use list_files or grep next."


def positive(value: object, message: str = "top_k must be >= 1.") -> int:
    """A count that a caller gives, checked before any work."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(message)
    return value


def score(terms: list[str], path: Column, content: Column) -> Column:
    """Of each term, as often as the query has it: weight + log1p(count), for counts above zero."""
    low_path, low_text = F.lower(path), F.lower(content)
    hit = lambda count, weight: F.when(count > 0, weight + F.log1p(count)).otherwise(0.0)
    each = [
        n * (hit(T.occurrences(low_text, t), BODY) + hit(T.occurrences(low_path, t), PATH) + hit(T.definitions(low_text, t), DEFINITION))
        for t, n in Counter(terms).items()
    ]
    return reduce(add, each, F.lit(0.0))


def score_files(files: DataFrame, query: str) -> DataFrame:
    """The text files with their score; a file without content could not be read, and is left out."""
    return files.where(is_text_file(F.col("path")) & F.col("content").isNotNull()).withColumn("score", score(T.query_terms(query), F.col("path"), F.col("content")))


def retrieve(files: DataFrame, query: str, top_k: int = TOP_K, excerpt_chars: int = EXCERPT_CHARS) -> DataFrame:
    """(path, score, excerpt) of the top k files, best first; ties by path."""
    terms = T.query_terms(query)
    best = score_files(files, query).select("path", "content", "score").orderBy(F.desc("score"), "path").limit(positive(top_k)).where("score > 0")
    return best.select("path", "score", T.excerpt(F.col("content"), terms, excerpt_chars).alias("excerpt") if terms else F.lit("").alias("excerpt"))


def joined(rows: DataFrame, order: list[str], text: Column, separator: str, empty: str, cap: int = 0, marker: str = "") -> DataFrame:
    """One row with the texts of a few rows, in order; ``empty`` if there are none, the marker behind ``cap`` of them."""
    placed = F.struct(*order, text.alias("_text"))
    one = rows.agg(F.sort_array(F.collect_list(placed))["_text"].alias("t"))
    filled = F.array_join(F.array_append("t", F.lit(marker)), separator) if marker else F.array_join("t", separator)
    return one.select(F.when(F.size("t") == 0, F.lit(empty)).when(F.size("t") >= (cap or (1 << 30)), filled).otherwise(F.array_join("t", separator)).alias("output"))


def retrieval_notes(files: DataFrame, query: str | None, top_k: int = TOP_K, excerpt_chars: int = EXCERPT_CHARS) -> DataFrame:
    """The top k files as one text: a heading with the score and a fenced excerpt each."""
    positive(top_k)
    if not T.query_terms(query):
        return files.sparkSession.range(1).select(F.lit(NO_TERMS).alias("output"))
    block = F.format_string("## %s score=%.2f\n```\n%s\n```", "path", "score", "excerpt")
    return joined(retrieve(files, query, top_k, excerpt_chars).withColumn("rank", -F.col("score")), ["rank", "path"], block, "\n\n", NO_FILES)
