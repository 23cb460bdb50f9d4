"""Operator 8: mixing sources to target weights.

The words of a source form one stream, cut into blocks of ``block_words``.  A
source with ``n`` blocks and target ``t`` has the quota ``round(n * t / size)`` of
the mixture's slots, at most ``cap * n``.  The mixture is dealt in output shards
of ``shard_slots`` slots.

The source counts of a shard are multinomial, given that all shards together use
each quota up: the slots of the mixture are numbered by source, and a pseudorandom
permutation of all numbers says at which place of which shard each is; a shard so
draws its numbers by the inverse distribution function of the quotas, without
replacement.  The counts of a shard vary as those of independent draws do (less by
the part that the shard is of the mixture), and no total misses its quota.
:func:`shard_counts` has them.  Every slot is computed by itself, so no row of a
source and shard is made that has no slot.

Slot ``j`` of a source takes block ``perm(j mod n)``, by a permutation for each pass
over the source, so every block is used once before any block a second time.
Slots and blocks are joined by index.

The stream order is (bucket of the row, id, size), so offsets are running sums
within small buckets, within groups of buckets and over the groups; no source is
sorted in one task.  Rows that repeat source, id and size are counted before that
and dealt out after it, in parts where there are many.  Sources are ranked in
ranges of ``TASK_SOURCES``.  Permutations are Feistel networks over a rectangle that
just holds the index range, walked until they land in it, so an index is
computed, not looked up.

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, last in order; repeated rows are documents of their own; null
ids and one id on many rows are spread by their sizes; an empty table gives an
empty result.  Only ``doc_id``, ``text`` and ``source`` are read.  All draws
depend on the ids and sizes alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, materialize, word_array

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Slots that a task makes.
TASK_SLOTS = 1 << 18
#: Rows of a bucket of the stream order, on average; buckets of a group, whose sums are added up together; sources of a task; copies of a row that a task deals out.
BUCKET_DOCS = 32
GROUP = 4096
TASK_SOURCES = 20_000
TASK_COPIES = 1 << 16
#: Hashes multiply 31 bits, so that products fit a long, and keep the highest HASH_BITS; odd multipliers (fixed values of a known hash).
BITS, HASH_BITS = (1 << 31) - 1, 24
MULT_A, MULT_B = 0x7FEB352D, 0x2C1B3C6D
ROUNDS_SEED = 7919
ROUNDS = 4
#: Tells the permutation of all slots from those of the sources.
ORDER_SALT = 104_729
#: Steps of a walk.  One that would need more (chance below 1e-100) stops the job, and loses nothing silently.
WALK = 64


def hashed(x: Column, salt: Column) -> Column:
    """A hash of HASH_BITS bits."""
    x = ((x + salt).bitwiseAND(F.lit(BITS)) * MULT_A).bitwiseAND(F.lit(BITS))
    return F.shiftright((x.bitwiseXOR(F.shiftright(x, 15)) * MULT_B).bitwiseAND(F.lit(BITS)), 31 - HASH_BITS)


def permuted(x: Column, n: Column, salt: Column) -> Column:
    """The image of x under a pseudorandom permutation of 0..n-1."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / a).cast("long")

    def once(v: Column, p: Column) -> Column:
        def step(lr: Column, i: Column) -> Column:
            right = (lr.r + hashed(lr.l, p.salt + i * ROUNDS_SEED)) % p.b
            return F.struct(((lr.l + hashed(right, p.salt + (i + ROUNDS) * ROUNDS_SEED)) % p.a).alias("l"), right.alias("r"))

        start = F.struct(F.floor(v / p.b).cast("long").alias("l"), (v % p.b).alias("r"))
        return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), start, step, lambda lr: lr.l * p.b + lr.r)

    def walked(p: Column) -> Column:
        # The rectangle has fewer than sqrt(n) + 1 indices too many: walks are short.
        far = lambda first: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < p.n, v).otherwise(once(v, p)))
        lost = F.raise_error(F.lit("a walk of a permutation is too long")).cast("long")
        inside = lambda v: F.when(v < p.n, v).otherwise(lost)
        return let(once(p.x, p), lambda first: F.when(first < p.n, first).otherwise(let(far(first), inside)))

    return let(F.struct(x.alias("x"), n.alias("n"), salt.alias("salt"), a.alias("a"), b.alias("b")), walked)


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(word_array(F.col("text"))).cast("long").alias("size"))


def _earlier(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows: ``part`` numbers ranges of ``order``."""
    none = F.lit(0).cast("long")
    totals = df.groupBy("part").agg(F.sum(value).alias("_total"))
    starts = totals.select("part", F.coalesce(F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), none).alias("_start"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(own), none))
    return within.join(starts, "part").withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def _water_level(weighed: DataFrame, share: float) -> float:
    """What a unit of weight gets: sources whose cap is below that are full, and what they leave is shared by the others.

    Each step is one sum over the sources; full ones stay full, so steps end.
    """
    total, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    if not weights:
        return 0.0
    level, n_full = share * total / weights, 0
    while True:
        full = F.col("most") < F.col("weight") * F.lit(level)
        count, taken, gone = weighed.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(full, F.col("weight")))).first()
        if count == n_full or gone == weights:
            return level
        level, n_full = (share * total - taken) / (weights - gone), count


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a source: source, sid, weight, source_size, target, n_blocks, n_slots, first_slot, all_slots."""
    order = F.col("source").asc_nulls_last()
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-sources")
    in_parts = per.repartitionByRange(1 + per.count() // TASK_SOURCES, order).withColumn("part", F.spark_partition_id())
    ranked = _earlier(materialize(in_parts, "mixing-parts"), F.lit(1).cast("long"), [order], "sid")
    weight = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    weighed = materialize(ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")), "mixing-weights")
    level = F.lit(_water_level(weighed, share))
    target = F.when(F.col("most") < F.col("weight") * level, F.col("most").cast("double")).otherwise(F.col("weight") * level)
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    n_slots = F.when(F.col("source_size") > 0, F.least(cap * F.col("n_blocks"), F.floor(F.col("n_blocks") * F.col("target") / F.col("source_size") + 0.5).cast("long"))).otherwise(F.lit(0).cast("long"))
    counted = weighed.withColumn("target", target).withColumn("n_blocks", n_blocks).withColumn("n_slots", n_slots)
    placed = _earlier(counted, F.col("n_slots"), [F.col("sid")], "first_slot")
    total = counted.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    return placed.select("source", "sid", "weight", "source_size", "target", "n_blocks", "n_slots", "first_slot", F.lit(total).cast("long").alias("all_slots"))


def _before(df: DataFrame, value: Column, order: list[str], name: str, total: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of a source: within (sid, grp) by ``order``, and over the groups before.

    ``total`` names the sum of a group; a source has one row a group there.
    """
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    groups = df.groupBy("sid", "grp").agg(F.sum(value).alias(total))
    starts = groups.select("sid", "grp", F.coalesce(F.sum(total).over(until(Window.partitionBy("sid").orderBy("grp"))), none).alias("_start"))
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(until(Window.partitionBy("sid", "grp").orderBy(*order))), none))
    return within.join(starts, ["sid", "grp"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def slots(targets: DataFrame, shard_slots: int = SHARD_SLOTS, cap: int = CAP) -> DataFrame:
    """One row a slot of the mixture: shard, slot, sid, block, epoch."""
    total = targets.agg(F.coalesce(F.max("all_slots"), F.lit(0))).first()[0]
    numbers = lambda low, high: F.explode(F.sequence(low.cast("long"), high.cast("long")))
    runs = targets.where("n_slots > 0").select("sid", "n_blocks", "n_slots", "first_slot", "all_slots", numbers(F.lit(0), F.floor((F.col("n_slots") - 1) / GROUP)).alias("run"))
    spread = runs.repartition(1 + total // TASK_SLOTS, "sid", "run")
    each = spread.select("sid", "n_blocks", "first_slot", "all_slots", numbers(F.col("run") * GROUP, F.least((F.col("run") + 1) * GROUP, F.col("n_slots")) - 1).alias("j"))
    each = each.withColumn("epoch", F.floor(F.col("j") / F.col("n_blocks")).cast("long"))
    place = permuted(F.col("first_slot") + F.col("j"), F.col("all_slots"), F.lit(ORDER_SALT).cast("long"))
    block = permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), cap * F.col("sid") + F.col("epoch"))
    placed = each.select(place.alias("place"), "sid", block.alias("block"), "epoch")
    return placed.select(F.floor(F.col("place") / shard_slots).cast("long").alias("shard"), (F.col("place") % shard_slots).alias("slot"), "sid", "block", "epoch")


def shard_counts(targets: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, sid, count): how many slots each source has in each shard that has any."""
    return slots(targets, shard_slots).groupBy("shard", "sid").agg(F.count("*").alias("count"))


def placed_documents(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents with sid, source_size, target and the offset of their words in the source's stream."""
    alike = materialize(sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")), "mixing-alike")
    n_alike, most = alike.agg(F.count("*"), F.max("copies")).first()
    n_buckets = max(1, -(-n_alike // BUCKET_DOCS))
    keyed = alike.withColumn("own_source", F.col("source")).drop("source")
    known = keyed.join(targets, keyed.own_source.eqNullSafe(targets.source)).select("doc_id", "size", "copies", "sid", "source_size", "target")
    doc = F.coalesce("doc_id", F.lit(0).cast("long"))
    folded = doc.bitwiseAND(F.lit(BITS)).bitwiseXOR(F.shiftright(doc, 31).bitwiseAND(F.lit(BITS)))
    bucketed = known.withColumn("bucket", hashed(hashed(folded, F.lit(ROUNDS_SEED)) + F.col("size"), F.lit(2)) % n_buckets)

    here = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("copies")
    sums = bucketed.groupBy("sid", "bucket").agg(F.sum(words).alias("in_bucket")).withColumn("grp", F.floor(F.col("bucket") / GROUP).cast("long"))
    starts = _before(sums, F.col("in_bucket"), ["bucket"], "start", "in_group").select("sid", "bucket", "start")
    within = bucketed.withColumn("within", F.coalesce(F.sum(words).over(here), F.lit(0).cast("long"))).join(starts, ["sid", "bucket"])
    at = within.select("doc_id", "size", "sid", "source_size", "target", "copies", (F.col("start") + F.col("within")).alias("start"))
    numbers = lambda low, high: F.explode(F.sequence(low.cast("long"), high.cast("long")))
    if (most or 0) > TASK_COPIES:
        parts = at.withColumn("part", numbers(F.lit(0), F.floor((F.col("copies") - 1) / TASK_COPIES)))
        at = parts.repartition("sid", "doc_id", "size", "part")
        low, high = F.col("part") * TASK_COPIES, F.least((F.col("part") + 1) * TASK_COPIES, F.col("copies")) - 1
    else:
        low, high = F.lit(0), F.col("copies") - 1
    each = at.withColumn("copy", numbers(low, high))
    return each.select("doc_id", "size", "sid", "source_size", "target", (F.col("start") + F.col("copy") * F.col("size")).alias("offset"))


def block_pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document and block it reaches into: sid, block, doc_id, offset, from_word, n_words."""
    end = F.col("offset") + F.col("size")
    blocks = F.sequence(F.floor(F.col("offset") / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long"))
    start = F.greatest(F.col("offset"), F.col("block") * block_words)
    return (
        placed.where("size > 0")
        .select("sid", "doc_id", "size", "offset", "source_size", "target", F.explode(blocks).alias("block"))
        .select("sid", "block", "doc_id", "size", "offset", "source_size", "target", (start - F.col("offset")).alias("from_word"), (F.least(end, (F.col("block") + 1) * block_words) - start).alias("n_words"))
    )


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture by reference: shard, slot, epoch, doc_id, from_word, n_words."""
    sizes = materialize(document_sizes(docs), "mixing-sizes")
    targets = materialize(source_targets(sizes, block_words=block_words), "mixing-targets")
    pieces = block_pieces(placed_documents(sizes, targets), block_words)
    # Slots grow with the words of the corpus, which the size of the targets does not tell: never broadcast.
    return slots(targets).hint("merge").join(pieces, ["sid", "block"]).select("shard", "slot", "epoch", "doc_id", "from_word", "n_words")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target and taken, the words that the mixture takes."""
    sizes = materialize(document_sizes(docs), "mixing-sizes")
    targets = materialize(source_targets(sizes, block_words=block_words), "mixing-targets")
    placed = materialize(placed_documents(sizes, targets), "mixing-placed")
    times = slots(targets).groupBy("sid", "block").agg(F.count("*").alias("times")).hint("merge")
    taken = (
        block_pieces(placed, block_words)
        .join(times, ["sid", "block"], "left")
        .groupBy("sid", "offset", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.col("n_words") * F.coalesce("times", F.lit(0).cast("long"))).alias("taken"))
    )
    columns = ("doc_id", "size", "source_size", "target", "taken")
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*columns).union(empty.select(*columns))
