from __future__ import annotations

import random

import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import connected_components

from .conftest import DOCS, messy_rows, prose


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int]) -> list[int]:
    """Of each position the least position reachable."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_the_definition():
    texts = [r[1] for r in messy_rows()] + ["a b", "A B", "a b c d", "x\x0by\x0cz w", prose(5, 300)]
    assert [simhash.fingerprint(t) % (1 << 64) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_links_find_every_pair_in_small_and_large_buckets(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:10]:
        fps += [base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(4)]
    # More than PAIR_BUCKET fingerprints that agree on the low 32 bits.
    low = rng.getrandbits(32)
    hot = [low | rng.getrandbits(4) << 40 | rng.getrandbits(4) << 60 | rng.getrandbits(6) << 34 for _ in range(400)]
    fps = sorted({*fps, *hot})
    assert len([f for f in fps if f & 0xFFFFFFFF == low]) > simhash.PAIR_BUCKET
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node % (1 << 64): r.root for r in connected_components(simhash.hamming_links(df)).collect()}
    want = brute_components(fps)
    groups: dict[int, set[int]] = {}
    for f, root in zip(fps, want, strict=True):
        groups.setdefault(root, set()).add(f)
    for group in groups.values():
        assert len({roots.get(f) for f in group}) == 1
        assert len(group) == 1 or None not in {roots.get(f) for f in group}
    assert len({r for r in roots.values()}) == sum(len(g) > 1 for g in groups.values())


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(i, 120) for i in range(6)]
    texts = base + [b.upper() for b in base[:3]] + [b + " " + prose(90 + i, 1) for i, b in enumerate(base)] + [None, "", "  "]
    rows = [(100 - i, t, "en", "web", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    ordered = sorted(rows)
    want = brute_components([brute_fingerprint(r[1]) for r in ordered])
    assert got == {r[0]: ordered[root][0] for r, root in zip(ordered, want, strict=True)}


def test_one_document_of_each_group_stays(spark):
    rows = [(1, prose(1, 90), "en", "a", 0), (2, prose(1, 90), "de", "b", 0), (3, prose(2, 90), "en", "a", 0), (3, prose(2, 90), "en", "a", 0)]
    assert [(r.doc_id, r.lang) for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()] == [(1, "en"), (3, "en")]


def test_rows_are_kept_one_by_one_whatever_their_ids(spark):
    """Ids that are null or name two texts, and ties that other columns decide."""
    p, q, r = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(1, p, "en", "a", 0), (None, p, "en", "a", 0), (5, p, "en", "a", 0), (5, q, "en", "a", 0), (None, r, "de", "b", 1), (None, r, "de", "b", 1)]
    got = [tuple(x) for x in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
    ties = [(7, p, lang, source, 0) for lang in ("en", "de", "fr") for source in ("a", "b")]
    first, again = (simhash.keep_one(spark.createDataFrame(x, DOCS)).collect() for x in (ties, ties[::-1]))
    assert first == again and len(first) == 1


def test_messy_rows_and_empty_tables(messy, no_docs):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    # One of 1, 2 and 3, of 4 and 5, and of the rows of 6; that with a null id is the only one of its text.
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted([1, 4, 6, 7, 8, 9, 10, None], key=str)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
