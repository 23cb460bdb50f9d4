from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing

from .conftest import DOCS, prose


def brute_targets(sizes: dict) -> dict:
    """Water filling: shares by weight, what is above 2 times a size is reshared until none is."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


def corpus() -> list[tuple]:
    rng = random.Random(8)
    sources = ["web"] * 60 + ["books", "code", "news", "wiki", "é", None]
    return [(i, prose(i, rng.choice((0, 1, 30, 200, 700))), "en", rng.choice(sources), 0) for i in range(600)]


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    return docs, mixing.mixed_documents(docs).collect()


def test_targets_equal_water_filling(mixed):
    rows, by_id = corpus(), {r.doc_id: r for r in mixed[1]}
    sizes: dict = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = brute_targets(sizes)
    assert len(by_id) == len(rows)
    for doc_id, text, _, source, _ in rows:
        r = by_id[doc_id]
        assert (r.size, r.source_size) == (len(text.split()), sizes[source])
        assert r.target == pytest.approx(want[source], rel=1e-9)


def test_taken_words_come_near_the_target(mixed):
    rows, by_id = corpus(), {r.doc_id: r for r in mixed[1]}
    assert all(0 <= r.taken <= 2 * r.size for r in by_id.values())
    for source in {r[3] for r in rows}:
        own = [by_id[r[0]] for r in rows if r[3] == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 * mixing.BLOCK_WORDS


def test_a_permutation_hits_each_index_once(spark):
    for n in (1, 2, 3, 5, 7, 64, 1000, 4097):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        got = sorted(r.p for r in df.collect())
        assert got == list(range(n))


def test_slots_fill_shards(spark, mixed):
    targets = mixing.source_targets(mixing.document_sizes(mixed[0]))
    quota = {r.sid: r.n_slots for r in targets.collect()}
    counts = mixing.shard_counts(targets, shard_slots=50).collect()
    total, by_shard = sum(quota.values()), {}
    for r in counts:
        by_shard.setdefault(r.shard, []).append(r["count"])
    assert {shard: sum(own) for shard, own in by_shard.items()} == {shard: min(50, total - 50 * shard) for shard in range(-(-total // 50))}
    assert len({tuple(own) for own in by_shard.values()}) > 5
    # Every source comes to its quota.
    assert {sid: sum(r["count"] for r in counts if r.sid == sid) for sid in quota} == quota

    slots = mixing.slots(targets, shard_slots=50)
    assert slots.count() == slots.select("shard", "slot").distinct().count() == total
    # No block is used a second time before all blocks were used once.
    uses = slots.groupBy("sid", "block").agg(F.count("*").alias("n"), F.max("epoch").alias("epoch"))
    assert uses.where("n > 2 or n <> epoch + 1").count() == 0


def test_counts_of_shards_are_multinomial_draws(spark):
    """Over 400 shards a count varies as that of independent draws, and no total misses its quota."""
    quotas, shard = [12_000, 3_900, 24_000, 100], 100
    rows = [(i, 5_000 + i, n, sum(quotas[:i]), sum(quotas)) for i, n in enumerate(quotas)]
    targets = spark.createDataFrame(rows, "sid long, n_blocks long, n_slots long, first_slot long, all_slots long")
    counts = {i: [0] * 400 for i in range(4)}
    for r in mixing.shard_counts(targets, shard).collect():
        counts[r.sid][r.shard] = r["count"]
    assert [sum(counts[i]) for i in range(4)] == quotas
    assert [sum(own) for own in zip(*counts.values(), strict=True)] == [shard] * 400
    for i in range(3):
        p = quotas[i] / sum(quotas)
        variance = sum((c - shard * p) ** 2 for c in counts[i]) / 400
        assert abs(variance / (shard * p * (1 - p)) - 1) < 0.2, (i, variance)
    # The rarest is in 0.25 slots of a shard: most have none, some more than one.
    assert counts[3].count(0) > 280 and max(counts[3]) > 1


def test_many_sources(spark):
    """A hundred thousand sources make a row for each slot, and none for sources and shards that do not meet."""
    sizes = spark.range(100_000).select("id", (F.col("id") % 50 + 40).alias("size")).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), "size")
    targets = mixing.source_targets(sizes).cache()
    one = targets.agg(F.count("*").alias("n"), F.min("sid").alias("low"), F.max("sid").alias("high"), F.sum("n_slots").alias("slots"), F.max("all_slots").alias("all"), F.sum("target").alias("target"), F.sum("source_size").alias("size")).first()
    assert (one.n, one.low, one.high) == (100_000, 0, 99_999) and one.slots == one["all"]
    assert abs(one.target - 1.5 * one["size"]) < 1e-6 * one["size"]
    assert targets.where("target > 2 * source_size").count() == 0
    names = sorted(f"s{i}" for i in range(100_000))
    assert [r.source for r in targets.where("sid in (0, 5000, 99999)").orderBy("sid").collect()] == [names[0], names[5000], names[99_999]]
    assert mixing.slots(targets).count() == one.slots
    targets.unpersist()


def test_one_row_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_COPIES", 7)
    docs = spark.createDataFrame([(None, "a b c", "en", "a", 0)] * 100 + [(1, "d", "en", "a", 0)], DOCS)
    sizes = mixing.document_sizes(docs)
    placed = mixing.placed_documents(sizes, mixing.source_targets(sizes)).orderBy("offset").collect()
    assert [r.offset for r in placed] == [0, *(r.offset + r["size"] for r in placed)][:-1] and len(placed) == 101


def test_ties_of_null_and_repeated_ids(spark):
    """Rows without ids, or all with one, and exact repeats are documents of their own."""
    rows = [(None, prose(i % 7, 30 + i % 11), "en", "a", 0) for i in range(300)] + [(5, prose(i % 3, 64), "en", "b", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(docs)
    got = out.collect()
    assert len(got) == 400 and all(0 <= r.taken <= 2 * r.size for r in got)
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert sum(r.size for r in own) == size and abs(sum(r.taken for r in own) - own[0].target) <= 4 * mixing.BLOCK_WORDS
    placed = mixing.placed_documents(mixing.document_sizes(docs), mixing.source_targets(mixing.document_sizes(docs))).collect()
    for sid in (0, 1):
        own = sorted((r for r in placed if r.sid == sid), key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *(r.offset + r["size"] for r in own)][:-1]


def test_the_mixture_agrees_with_the_counts(spark, mixed):
    taken = {r.doc_id: r.n for r in mixing.mixture(mixed[0]).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert taken == {r.doc_id: r.taken for r in mixed[1] if r.taken}


def test_reruns_agree(mixed):
    again = mixing.mixed_documents(mixed[0].repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed[1]))


def test_messy_rows_and_empty_tables(messy, no_docs):
    rows = mixing.mixed_documents(messy).collect()
    assert len(rows) == messy.count()
    assert {(r.size, r.taken) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert mixing.mixed_documents(no_docs).count() == 0
