"""Operator 3: near duplicates by SimHash and pigeonhole blocks.

A fingerprint has 64 bits, cut into four blocks of 16.  Two fingerprints that
differ in at most two bits differ in at most two blocks, so they agree on one of
the six pairs of blocks.  Distinct fingerprints meet on those 32-bit keys:

* a bucket of up to ``PAIR_BUCKET`` fingerprints is compared pair by pair;
* in a larger bucket each fingerprint goes to itself and to the 32 values that
  differ from it in one bit outside the key.  Two fingerprints of the bucket are
  within two bits exactly if they share such a value, and at most 33 distinct
  fingerprints share one, so the work stays linear in the bucket.

Both ways find every pair within two bits (the second as stars around the
least member), and no bucket is cut off.

Defined results: null or wordless text has fingerprint zero and links like any
other; equal texts share a fingerprint; a repeated row gets a row of its own;
null ids are no candidates for ``component_id`` unless a whole group has none;
:func:`keep_one` keeps one row of each component, also where ids repeat or are
null; an empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, row_hash, whole_row
from lodestone.llm.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 2
PAIR_BUCKET = 48
#: Shingles whose bits are counted at once; bounds the memory of a long text.
CHUNK = 1 << 15

_BLOCKS = [0xFFFF << shift for shift in (0, 16, 32, 48)]
_KEYS = [a | b for i, a in enumerate(_BLOCKS) for b in _BLOCKS[i + 1 :]]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def shingle_hashes(text: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a lower-cased text, in arrays of up to CHUNK."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit number."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes((text or "").encode()):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ball(fp: Column, key: int) -> Column:
    """fp and what differs from it in one bit outside ``key``."""
    free = [b for b in range(64) if not key >> b & 1]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << b))) for b in free])


def hamming_links(fps: DataFrame) -> DataFrame:
    """(u, v): links among distinct fingerprints ``fp`` that join all pairs within RADIUS bits."""
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(key))).alias("key")) for i, key in enumerate(_KEYS)])
    keyed = materialize(fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.k", "x.key"), "simhash-keys")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = keyed.join(sizes, ["k", "key"])

    near = lambda a, b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)
    small = shared.where(f"size <= {PAIR_BUCKET}").groupBy("k", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: near(a, b)), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    small_links = small.select(F.explode(pairs).alias("p")).select("p.u", "p.v")

    ball = reduce(lambda acc, i: acc.when(F.col("k") == i, _ball(F.col("fp"), _KEYS[i])), range(1, len(_KEYS)), F.when(F.col("k") == 0, _ball(F.col("fp"), _KEYS[0])))
    near_values = shared.where(f"size > {PAIR_BUCKET}").select("fp", "k", F.explode(ball).alias("z"))
    stars = near_values.groupBy("k", "z").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
    hot_links = stars.select(F.col("fps")[0].alias("u"), F.explode(F.slice("fps", 2, 33)).alias("v"))
    return small_links.union(hot_links).distinct()


def _classes(distinct: DataFrame) -> DataFrame:
    """``distinct``, which has each fingerprint once, with ``root``, the least fingerprint of its component."""
    roots = materialize(connected_components(hamming_links(distinct.select("fp"))), "simhash-roots")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    own = materialize(fingerprints(docs), "simhash-fingerprints")
    rooted = _classes(materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(firsts, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def _fingerprinted_rows(docs: DataFrame) -> DataFrame:
    """(row, fp, rid): the rows as structs, numbered; only texts go through Python."""

    @F.arrow_udf("long")
    def fingerprinted(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(text.as_py()) for text in texts], pa.int64())

    rows = docs.select(whole_row(docs), fingerprinted(F.col("text").cast("string")).alias("fp"))
    return rows.withColumn("rid", F.monotonically_increasing_id())


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, whatever its id: the least by id (null last), text and then all columns, by hash.

    Rows that are equal in all columns count as one.  Fingerprints, ids and hashes
    decide; texts are written once beside their fingerprints and only travel
    where the numbers of the dropped rows are too many for a broadcast.
    """
    own = materialize(_fingerprinted_rows(docs), "simhash-rows")
    order = F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").alias("i"), F.xxhash64("row.text").alias("t"), row_hash(docs).alias("r"), "rid")
    rooted = _classes(materialize(own.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.rid")
    dropped = materialize(own.select("rid").join(kept, "rid", "left_anti"), "simhash-dropped")
    return own.join(dropped, "rid", "left_anti").select("row.*")
