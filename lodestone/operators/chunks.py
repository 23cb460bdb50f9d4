"""Search and scores over files that come as chunk rows: (path, part, content).

A file of any size is many rows, each a stretch of its text; nothing here puts a
text together again.  What a cut goes through is put together instead: the line
at either side of it, or the run of word characters and white space there, in
which every term and definition lies.  Only those ends travel, in order of the
parts; what lies between them stays in its row.  So lines, counts that do not
overlap and definitions are those of the whole text wherever it is cut.

``sources.repo.scan_chunks`` reads a tree that way; :func:`chunked` cuts a table.
A single line or run is one value, as it is for a search in it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestone.functions import regex as R
from lodestone.functions import text as T
from lodestone.functions.paths import is_text_file
from lodestone.operators.files import checked_pattern
from lodestone.operators.retrieve import BODY, DEFINITION, PATH, TOP_K, positive

CHUNK_CHARS = 1 << 20
#: What terms and definitions consist of, as a Java class: characters of words and white space.
_RUN = r"(?U)^[\w\s\p{L}\p{N}]+"


def chunked(files: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows of (path, content) as (path, part, content) of ``chars`` characters each; a null or empty text is one part."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("content") - 1) / chars).cast("int")))
    parts = files.select("path", "content", F.explode(F.coalesce(starts, F.array(F.lit(0)))).alias("part"))
    return parts.select("path", "part", F.substr("content", F.col("part") * chars + 1, F.lit(chars)).alias("content"))


def _before() -> WindowSpec:
    return Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _joined(pieces: DataFrame, *key: str) -> DataFrame:
    """(path, key, text): the pieces (path, key, part, side, text) of one key, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "side", "text")))["text"]
    return pieces.groupBy("path", *key).agg(F.array_join(ordered, "").alias("text"))


def lines(chunks: DataFrame) -> DataFrame:
    """(path, line_no, line): the lines of each text, as of the whole."""
    own = chunks.where(F.col("content").isNotNull() & (F.col("content") != "")).select("path", "part", "content")
    # The second half of a line end that is cut in two is dropped.
    ends = own.select("path", "part", F.right("content", F.lit(1)).alias("last"), F.left("content", F.lit(1)).alias("first"), F.regexp_count("content", F.lit(T.LINE_END)).alias("n"))
    order = Window.partitionBy("path").orderBy("part")
    split = F.coalesce((F.lag("last").over(order) == "\r") & (F.col("first") == "\n"), F.lit(False))
    # Of a chunk that begins with that half, it is counted as a line end of its own.
    counted = ends.withColumn("split", split).withColumn("n", F.col("n") - F.col("split").cast("int"))
    placed = counted.select("path", "part", "split", F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("path")).alias("all_ends"))
    both = own.join(placed, ["path", "part"])
    text = F.when(F.col("split"), F.expr("substring(content, 2)")).otherwise(F.col("content"))
    pieces = both.select("path", "part", "start", "all_ends", F.split(text, T.LINE_END).alias("pieces"))
    each = pieces.select("path", "part", "start", "all_ends", F.size("pieces").alias("n"), F.posexplode("pieces").alias("k", "text"))
    numbered = each.withColumn("line_no", (F.col("start") + F.col("k") + 1).cast("int"))
    inside = numbered.where("k > 0 and k < n - 1").select("path", "line_no", F.col("text").alias("line"))
    # At a cut a line goes on in the next part; what follows the last line end is no line if it is empty.
    at_cuts = _joined(numbered.where("k = 0 or k = n - 1").withColumnRenamed("k", "side"), "line_no", "all_ends")
    return inside.union(at_cuts.where("not (text = '' and line_no = all_ends + 1)").select("path", "line_no", F.col("text").alias("line")))


def grep(chunks: DataFrame, pattern: str) -> DataFrame:
    """(path, line_no, line) of the lines of text files in which the pattern is found."""
    found = lines(chunks.where(is_text_file(F.col("path"))))
    return found.where(R.searched(F.col("line"), checked_pattern(pattern)))


def fragments(chunks: DataFrame) -> DataFrame:
    """(path, text): stretches of the texts that no term or definition goes beyond."""
    content = F.coalesce("content", F.lit(""))
    own = chunks.select("path", "part", content.alias("content"), F.regexp_extract(content, _RUN, 0).alias("head"))
    whole = F.length("head") == F.length("content")
    # Turned around, so that the run at the end is found at once.
    tail = F.when(whole, F.lit("")).otherwise(F.reverse(F.regexp_extract(F.reverse("content"), _RUN, 0)))
    cut = own.withColumn("whole", whole).withColumn("tail", tail)
    middle = cut.select("path", F.substr("content", F.length("head") + 1, F.length("content") - F.length("head") - F.length("tail")).alias("text"))
    edges = cut.select("path", "part", "whole", "head", "tail")
    closed = edges.withColumn("run", F.coalesce(F.sum((~F.col("whole")).cast("long")).over(_before()), F.lit(0)))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("run").alias("run"), F.col("head").alias("text")), F.struct(F.lit(1).alias("side"), (F.col("run") + 1).alias("run"), F.col("tail").alias("text")))
    pieces = closed.select("path", "part", F.explode(sides).alias("s")).select("path", "part", "s.side", "s.run", "s.text").where("text <> ''")
    return middle.where("text <> ''").union(_joined(pieces, "run").select("path", "text"))


def score(chunks: DataFrame, query: str) -> DataFrame:
    """(path, score) of the text files, as of their whole texts; a path without any content is left out."""
    terms = T.query_terms(query)
    distinct = list(dict.fromkeys(terms))
    texts = chunks.where(is_text_file(F.col("path")))
    low = F.lower("text")
    counts = [F.sum(f(low, t)).alias(f"{kind}{i}") for i, t in enumerate(distinct) for kind, f in (("n", T.occurrences), ("d", T.definitions))]
    counted = fragments(texts).groupBy("path").agg(*counts) if counts else fragments(texts).select("path").distinct()
    paths = texts.groupBy("path").agg(F.max(F.col("content").isNotNull()).alias("known")).where("known").select("path")

    def hit(count: Column, weight: float) -> Column:
        return F.when(count > 0, weight + F.log1p(count)).otherwise(0.0)

    # A file without a fragment has counts of its path only.
    of = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long"))
    each = [terms.count(t) * (hit(of(f"n{i}"), BODY) + hit(T.occurrences(F.lower("path"), t), PATH) + hit(of(f"d{i}"), DEFINITION)) for i, t in enumerate(distinct)]
    return paths.join(counted, "path", "left").select("path", reduce(add, each, F.lit(0.0)).alias("score"))


def retrieve(chunks: DataFrame, query: str, top_k: int = TOP_K) -> DataFrame:
    """(path, score) of the best files; ties by path."""
    return score(chunks, query).orderBy(F.desc("score"), "path").limit(positive(top_k)).where("score > 0")
