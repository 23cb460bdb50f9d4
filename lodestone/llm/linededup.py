"""Operator 2: removal of passages of lines that repeat across the corpus.

A text is cut at ``\\n`` into lines, each with a hash and its number of words.
Chunks are found by a rolling hash over line hashes: a window of ``ROLL`` = 2
lines that have a word, with the wordless lines between them, is a chunk where its
rolling hash is 0 modulo ``divisor``.  A line of ``LONG_LINE`` words or more is a
chunk of its own, and two such lines are not joined.  What lies around a window
does not matter for it, so an insertion shifts no boundary.  The default divisor
of 1 takes the window at every line: a passage that occurs twice then has the same
chunks in both places and is found up to its edges, however few lines it has.
With a larger one there are fewer chunks, and what is between them is not found.

Chunks that occur in two places or more are found by (hash, bytes).  The first
place, by (doc_id, hash of the text, chunk number), keeps its lines.  Elsewhere
the chunk's text is compared with that of the first place, byte by byte; equal
ones count as repeated.  Repeated chunks that touch or overlap are one run.  A run
is removed if it has ``PASSAGE_WORDS`` words, or at least two lines and
``RUN_WORDS`` words; shorter runs, such as a single licence line, stay.

Defined results: null text stays null; rows that repeat id and text count as
one document and get the same result; lines without a word begin no chunk and go
only within a run; a window that overlaps its own first place, as in three equal
lines, stays; an empty table gives an empty result; other columns pass through,
except that columns named ``n_removed_lines`` and ``n_removed_words`` give way to
the counts.  Ids may be null (they order first) and need not be unique.  A text
that loses all its lines becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, let, materialize, whole_row

LONG_LINE = 20
ROLL = 2
DIVISOR = 1
RUN_WORDS = 20
PASSAGE_WORDS = 50


def _line_structs(text: Column) -> Column:
    """line, its hash and its number of words."""
    words = lambda line: F.size(F.array_remove(F.split(line, f"[{SPACE}]+"), ""))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), F.xxhash64(x).alias("h"), words(x).alias("w")))


def _windows(lines: Column, divisor: int) -> Column:
    """Two places for each line with a word, in order: the line if it is long, and its window with the next such line.

    Each is start, n_lines, key, bytes, or null.
    """

    def chunk(start: Column, n_lines: Column) -> Column:
        own = F.slice(lines, start + 1, n_lines)
        size = F.aggregate(own, n_lines - 1, lambda acc, x: acc + F.octet_length(x.line))
        return F.struct(start.alias("start"), n_lines.alias("n_lines"), F.xxhash64(own.h).alias("key"), size.alias("bytes"))

    def at_line(at: Column, after: Column) -> Column:
        line, following = F.get(lines, at), F.get(lines, after)
        alone = F.when(line.w >= LONG_LINE, chunk(at, F.lit(1)))
        # A null for the line after the last makes the condition null.
        joined = F.when((line.w < LONG_LINE) & after.isNotNull() | (following.w < LONG_LINE), chunk(at, after - at + 1))
        return F.array(alone, joined if divisor == 1 else let(joined, lambda c: F.when(F.pmod(c.key, F.lit(divisor)) == 0, c)))

    worded = F.filter(F.transform(lines, lambda x, i: F.when(x.w > 0, i)), lambda i: i.isNotNull())
    return let(worded, lambda own: F.flatten(F.transform(own, lambda at, k: at_line(at, F.get(own, k + 1)))))


def _text_of(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk.start + 1, chunk.n_lines).line, "\n")


def _keyed(docs: DataFrame) -> DataFrame:
    """id, text and th, a hash that tells the rows of one id apart."""
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text")


def _same_row(own: DataFrame, other: DataFrame) -> Column:
    return own.id.eqNullSafe(other.id) & (own.th == other.th)


def chunk_places(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(id, th, idx, key, bytes) of each chunk."""
    cut = _keyed(docs).select("id", "th", F.posexplode(let(_line_structs(F.col("text")), lambda lines: _windows(lines, divisor))).alias("idx", "c"))
    return cut.where("c is not null").select("id", "th", "idx", "c.key", "c.bytes")


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(id, th, repeats): the chunks of a text that occur earlier by hash, as (idx, text of the first place)."""
    places = materialize(chunk_places(docs, divisor), "line-places")
    place = F.struct("id", "th", "idx")
    spans = places.groupBy("key", "bytes").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("not first <=> last")
    firsts = materialize(spans.select("key", "bytes", "first"), "line-firsts")

    wanted = firsts.select("first.id", "first.th", F.struct("first.idx", "key", "bytes").alias("w")).groupBy("id", "th").agg(F.collect_list("w").alias("wanted"))
    holders = _keyed(docs)
    own = let(_line_structs(F.col("text")), lambda lines: let(_windows(lines, divisor), lambda c: F.transform("wanted", lambda w: F.struct(w.alias("w"), _text_of(lines, F.get(c, w.idx)).alias("text")))))
    texts = holders.join(wanted, _same_row(holders, wanted)).select(holders.id, holders.th, F.explode(own).alias("x"))
    texts = texts.select("x.w.key", "x.w.bytes", F.struct("id", "th", "x.w.idx").alias("first"), F.col("x.text").alias("first_text"))
    # A repeated row gives its texts twice.  Written, so that the join below is all that deals by chunk and a frequent one can be split.
    texts = materialize(texts.groupBy("key", "bytes").agg(F.any_value("first").alias("first"), F.any_value("first_text").alias("first_text")), "line-texts")
    overlaps = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("idx") % 2 == 1) & (F.col("idx") == F.col("first.idx") + 2)
    again = places.join(texts, ["key", "bytes"]).where(~place.eqNullSafe(F.col("first")) & ~overlaps)
    return again.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("idx", "first_text"))).alias("repeats"))


def _runs(lines: Column, chunks: Column, repeats: Column) -> Column:
    """start, end, n_lines and n_words of the runs of chunks whose bytes equal those of the first place."""
    equal = F.transform(
        F.filter(repeats, lambda r: _text_of(lines, F.get(chunks, r.idx)) == r.first_text),
        # The number of the line among those with a word, and of the one after the chunk: neither ever falls.
        lambda r: let(F.floor(r.idx / 2).cast("int"), lambda k: F.struct(F.get(chunks, r.idx).alias("c"), k.alias("line"), (k + 1 + r.idx % 2).alias("upto"))),
    )

    def cut(e: Column) -> Column:
        starts = F.filter(F.transform(e, lambda x, i: F.when((i == 0) | (F.get(e, i - 1).upto < x.line), i)), lambda i: i.isNotNull())

        def run(at: Column, k: Column) -> Column:
            last = F.coalesce(F.get(at, k + 1), F.size(e)) - 1
            return F.struct(F.get(e, F.get(at, k)).c.start.alias("start"), (F.get(e, last).c.start + F.get(e, last).c.n_lines).alias("end"))

        return let(starts, lambda at: F.transform(at, lambda _, k: run(at, k)))

    def sized(r: Column) -> Column:
        words = F.aggregate(F.slice(lines, r.start + 1, r.end - r.start), F.lit(0), lambda acc, x: acc + x.w)
        return F.struct(r.start.alias("start"), r.end.alias("end"), (r.end - r.start).alias("n_lines"), words.alias("n_words"))

    return F.transform(let(equal, cut), sized)


def _kept(text: Column, runs: Column) -> Column:
    def cut(lines: Column) -> Column:
        def part(k: Column) -> Column:
            start = F.coalesce(F.get(runs, k - 1).end, F.lit(0))
            return F.slice(lines, start + 1, F.coalesce(F.get(runs, k).start, F.size(lines)) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), part)), "\n")

    return let(F.split(text, "\n"), cut)


def _cut_rows(docs: DataFrame, divisor: int) -> DataFrame:
    """(row, new_text, n_lines, n_words): each row of ``docs``, what is left of its text and what went."""
    repeats = materialize(repeated_chunks(docs, divisor), "line-repeats")
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"))
    found = rows.join(repeats, _same_row(rows, repeats), "left").select("row", "repeats")
    text = F.col("row.text")
    runs = let(_line_structs(text), lambda lines: let(_windows(lines, divisor), lambda chunks: _runs(lines, chunks, F.col("repeats"))))
    with_runs = found.select("row", F.when(F.col("repeats").isNotNull(), runs).alias("runs"))
    large = with_runs.select("row", F.filter("runs", lambda r: (r.n_words >= PASSAGE_WORDS) | ((r.n_lines >= 2) & (r.n_words >= RUN_WORDS))).alias("runs"))
    count = lambda field: F.coalesce(F.aggregate(F.col("runs")[field], F.lit(0), lambda acc, n: acc + n), F.lit(0)).cast("long")
    new_text = F.when(F.size("runs") > 0, _kept(text, F.col("runs"))).otherwise(text)
    return large.select("row", new_text.alias("new_text"), count("n_lines").alias("n_lines"), count("n_words").alias("n_words"))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and n_removed_lines, n_removed_words."""
    counts = {"n_removed_lines": "n_lines", "n_removed_words": "n_words"}
    kept = [F.col("new_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counts]
    return _cut_rows(docs, divisor).select(*kept, *[F.col(c).alias(name) for name, c in counts.items()])


def without_passages(docs: DataFrame, length: str | None = None, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with its columns, and repeated passages cut from ``text``; a column ``length`` follows the texts that were cut."""

    def column(name: str) -> Column:
        own = F.col("row")[name]
        if name == length:
            own = F.when(F.col("n_lines") > 0, F.length("new_text").cast(docs.schema[name].dataType)).otherwise(own)
        return (F.col("new_text") if name == "text" else own).alias(name)

    return _cut_rows(docs, divisor).select(*map(column, docs.columns))
