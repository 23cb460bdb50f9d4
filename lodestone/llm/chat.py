"""Operator 9: chat formatting by quotation linking.

A line that begins with ``>`` marks is quoted, at the level that the number of
marks gives.  Adjacent lines of one level form a passage.  The sentences of a
passage are normalised (lower case, letters and digits, single spaces) and
hashed, so that a partly quoted or newly wrapped passage still matches.  The
original of a quoted sentence is the first message of the conversation that has
it in its own words and comes before the quoting message.

A message replies to the original of its quotes: of the lowest level first, then
with the most sentences, then the latest.  A message without a linked quote
replies to the one before it.  The first reply of a message goes on with its
branch; every other reply begins a branch of its own.  Branches are the
reply-ordered conversations: within a branch each message replies to the one
before it.  Contents are the messages without quoted lines and without the
attribution line (``On ... wrote:``) directly before a quote.

The order within a conversation is a running count over range partitions and
then over the partitions' totals, so a conversation of any size is spread over
tasks.  Messages that just follow each other are one segment; only segments are
chained, by pointer doubling, in rounds that grow with the logarithm of the
longest chain.

Defined results: null text is empty; a null conversation id is a conversation
of its own; null turns order first; messages of one turn are ordered by a hash
of role and text; repeated rows are one message and get the same result; a null
role is ``unknown``; the marks ``<|`` and ``|>`` in roles and contents are broken
by a space; an empty table gives an empty result.  Only ``conv_id``, ``turn``, ``role`` and ``text``
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, materialize

#: The marks of a quoted line, as a regex.
MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)^\s*on\s.*\swrote:\s*$"
SENTENCE_END = r"[.!?]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Of turns that are null.
NO_TURN = -(1 << 63)

_KEY = ["cid", "tkey", "th"]


def _lines(text: Column) -> Column:
    """level and content of each line, and the line itself."""

    def parsed(line: Column) -> Column:
        return let(
            F.regexp_extract(line, f"({MARKS})", 1),
            lambda marks: F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substr(line, F.length(marks) + 1).alias("content"), line.alias("line")),
        )

    return F.transform(F.split(text, "\n"), parsed)


def _passages(lines: Column) -> Column:
    """Runs of adjacent lines of one level: (level, contents), in order."""
    starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | (F.get(lines, i - 1).level != x.level), i)), lambda i: i.isNotNull())

    def cut(at: Column) -> Column:
        def run(start: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(at, j + 1), F.size(lines))
            return F.struct(F.get(lines, start).level.alias("level"), F.array_join(F.slice(lines, start + 1, stop - start).content, " ").alias("text"))

        return F.transform(at, run)

    return let(starts, cut)


def _sentence_hashes(text: Column) -> Column:
    normal = lambda s: F.trim(F.regexp_replace(F.lower(s), NOT_WORD, " "))
    return F.transform(F.filter(F.transform(F.split(text, SENTENCE_END), normal), lambda s: s != ""), lambda s: F.xxhash64(s))


def _contents(text: Column) -> Column:
    """The text without quoted lines and attributions."""

    def own(lines: Column) -> Column:
        follows = lambda i: F.coalesce(F.get(lines, i + 1).level > 0, F.lit(False))
        kept = F.filter(lines, lambda x, i: (x.level == 0) & ~(follows(i) & x.line.rlike(ATTRIBUTION)))
        return F.array_join(kept.line, "\n")

    return F.when(text.rlike(f"(?m){MARKS}"), F.trim(let(_lines(text), own), F.lit(" \t\r\n"))).otherwise(text)


def _messages(conversations: DataFrame) -> DataFrame:
    """The rows with cid, tkey and th, which tell messages apart."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    return conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("cid"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("tkey"),
        F.xxhash64(role, text).alias("th"),
    )


def _carried(df: DataFrame, value: Column, fold, name: str, none: Column) -> DataFrame:
    """Adds ``fold`` of ``value`` over the message and all before it in the conversation, as ``name``.

    First within each range partition, then over the totals of the partitions
    before, of which a conversation has as many as it has partitions.
    """
    here = Window.partitionBy("part", "cid").orderBy("tkey", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("cid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.select("part", "cid", value.alias("v")).groupBy("part", "cid").agg(fold("v").alias("v"))
    carry = totals.select("part", "cid", F.coalesce(fold("v").over(before), none).alias("carry"))
    within = df.withColumn("within", fold(value).over(here)).join(carry, ["part", "cid"])
    both = F.col("carry") + F.col("within") if fold is F.sum else F.greatest("carry", "within")
    return within.withColumn(name, both).drop("within", "carry")


def message_order(messages: DataFrame) -> DataFrame:
    """(cid, tkey, th, part, seq) of each distinct message; seq counts from 0 within a conversation."""
    keys = messages.select(*_KEY).distinct().repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id())
    placed = materialize(keys, "chat-keys")
    return _carried(placed, F.lit(1).cast("long"), F.sum, "seq", F.lit(0).cast("long")).withColumn("seq", F.col("seq") - 1)


def quote_links(messages: DataFrame, order: DataFrame) -> DataFrame:
    """(cid, seq, linked, n_links) of messages with a linked quote: whom it replies to, and its linked passages."""
    quoting = messages.where(F.col("text").rlike(f"(?m){MARKS}"))
    passages = quoting.select(*_KEY, F.posexplode(_passages(_lines(F.col("text")))).alias("passage", "p")).where("p.level > 0")
    units = passages.select(*_KEY, "passage", "p.level", F.explode(_sentence_hashes(F.col("p.text"))).alias("h"))
    quoted = materialize(units.join(order, _KEY).select("cid", "seq", "passage", "level", "h").distinct(), "chat-quotes")

    asked = quoted.select("cid").distinct()
    own = messages.join(asked, "cid", "left_semi").select(*_KEY, F.explode(_passages(_lines(F.col("text")))).alias("p")).where("p.level = 0")
    said = own.select(*_KEY, F.explode(_sentence_hashes(F.col("p.text"))).alias("h")).join(order, _KEY)
    firsts = said.groupBy("cid", "h").agg(F.min("seq").alias("first"))

    hits = quoted.join(firsts, ["cid", "h"]).where("first < seq")
    targets = hits.groupBy("cid", "seq", "passage", "level", "first").agg(F.count("*").alias("n"))
    best = F.max_by("first", F.struct((-F.col("level")).alias("l"), "n", "first"))
    return targets.groupBy("cid", "seq").agg(best.alias("linked"), F.count_distinct("passage").alias("n_links"))


def _chained(heads: DataFrame) -> DataFrame:
    """(cid, seg, root, skipped): the first segment of each segment's branch, and the messages before it there.

    ``heads`` has cid, seg, size and prev, the segment that it goes on from or null.
    """
    sizes = heads.select("cid", F.col("seg").alias("prev"), F.col("size").alias("skipped"))
    first = heads.join(sizes, ["cid", "prev"], "left").select("cid", "seg", F.coalesce("prev", "seg").alias("root"), F.coalesce("skipped", F.lit(0).cast("long")).alias("skipped"))
    current = materialize(first, "chat-chain")
    while True:
        # Segments that begin their branch point to themselves and skip nothing.
        up = current.select("cid", F.col("seg").alias("root"), F.col("root").alias("up"), F.col("skipped").alias("more"))
        moved = current.join(up, ["cid", "root"]).withColumn("moves", F.col("up") != F.col("root"))
        doubled = materialize(moved.select("cid", "seg", F.col("up").alias("root"), (F.col("skipped") + F.col("more")).alias("skipped"), "moves"), "chat-chain")
        current = doubled.drop("moves")
        if doubled.where("moves").isEmpty():
            return current


def reply_order(messages: DataFrame) -> DataFrame:
    """(cid, tkey, th, message_no, reply_to, branch, position, n_links) of each distinct message."""
    order = materialize(message_order(messages), "chat-order")
    links = quote_links(messages, order)
    parent = F.coalesce("linked", F.when(F.col("seq") > 0, F.col("seq") - 1))
    placed = order.join(links, ["cid", "seq"], "left").select(*_KEY, "part", "seq", parent.alias("reply_to"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    follows = F.coalesce(F.col("reply_to") == F.col("seq") - 1, F.lit(False))
    replies = materialize(placed.withColumn("begins", F.when(~follows, F.col("seq"))), "chat-replies")
    segmented = materialize(_carried(replies, F.col("begins"), F.max, "seg", F.lit(None).cast("long")), "chat-segments")

    sizes = segmented.groupBy("cid", "seg").agg(F.count("*").alias("size"))
    heads = segmented.where("begins is not null").select("cid", "seg", "reply_to")
    earliest = heads.where("reply_to is not null").groupBy("cid", "reply_to").agg(F.min("seg").alias("seg"))
    # A first reply goes on with the branch only where no message follows in the segment it replies to.
    parents = segmented.select("cid", F.col("seq").alias("reply_to"), F.col("seg").alias("prev"))
    ends = sizes.select("cid", F.col("seg").alias("prev"), (F.col("seg") + F.col("size") - 1).alias("reply_to"))
    goes_on = earliest.join(parents, ["cid", "reply_to"]).join(ends, ["cid", "prev", "reply_to"]).select("cid", "seg", "prev")
    chain = _chained(heads.join(sizes, ["cid", "seg"]).join(goes_on, ["cid", "seg"], "left").select("cid", "seg", "size", "prev"))
    return segmented.join(chain, ["cid", "seg"]).select(
        *_KEY,
        F.col("seq").alias("message_no"),
        "reply_to",
        F.col("root").alias("branch"),
        (F.col("skipped") + F.col("seq") - F.col("seg")).alias("position"),
        "n_links",
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row a row of ``conversations``: its place in the reply order, its content without quotes, and the formatted turn."""
    messages = _messages(conversations)
    ordered = materialize(reply_order(messages), "chat-replies")
    content = _contents(F.col("text"))
    n_quoted = F.regexp_count("text", F.lit(f"(?m){MARKS}")).cast("long")
    rows = messages.select("conv_id", "turn", "role", *_KEY, content.alias("content"), n_quoted.alias("n_quoted_lines"))
    broken = lambda c: F.replace(F.replace(F.col(c), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    formatted = F.concat(F.lit("<|"), broken("role"), F.lit("|>\n"), broken("content"), F.lit("<|end|>\n"))
    return rows.join(ordered, _KEY).select(
        "conv_id", "turn", "role", "message_no", "reply_to", "branch", "position", "n_quoted_lines", "n_links", "content", formatted.alias("formatted")
    )
