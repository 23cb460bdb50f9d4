from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import decontam

from .conftest import DOCS, prose

ITEMS = "item_id long, text string"


def brute_words(text: str | None) -> list[str]:
    return re.sub(f"[{re.escape(string.punctuation)}]", " ", (text or "").lower()).split()


def shingle_counts(words: list[str]) -> Counter:
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_leaks(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """(doc_id, item_id) where some window of the item's size is similar enough, by comparing them all."""
    own = {i: brute_words(t) for i, t in items}
    frequency = Counter(s for w in own.values() for s in shingle_counts(w))
    weight = lambda s: math.log1p(len(items) / frequency[s]) if frequency[s] > 1 else math.log1p(len(items))
    found = set()
    for doc_id, text in docs:
        words = brute_words(text)
        for item_id, item in own.items():
            a = shingle_counts(item)
            for at in range(len(words) - len(item) + 1) if a else ():
                b = shingle_counts(words[at : at + len(item)])
                both = sum(weight(s) * min(a[s], b[s]) for s in a)
                either = sum(weight(s) * max(a[s], b[s]) for s in a | b)
                if both / either >= 0.8:
                    found.add((doc_id, item_id))
                    break
    return found


def planted() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(4)
    items = [(i, prose(700 + i, n)) for i, n in enumerate((5, 6, 12, 16, 17, 30, 47, 90, 200))]
    items += [(50, items[4][1]), (51, "too few words here"), (52, None), (53, prose(800, 20) + " " + items[2][1])]
    docs = []
    for i in range(40):
        item = items[i % 9][1].split()
        if i % 4 == 1:
            item[rng.randrange(len(item))] = "changed"
        if i % 4 == 2:
            item = item[: len(item) // 2]
        shown = " ".join(item)
        docs.append((i, f"{prose(i, 40)} {shown.title() + '!' if i % 4 == 3 else shown} {prose(100 + i, 40)}"))
    return docs + [(90, None), (91, ""), (92, "a b")], items


def test_leaks_equal_brute_force(spark):
    docs, items = planted()
    rows = [(i, t, "en", "web", 0) for i, t in docs]
    got = decontam.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    want = brute_leaks(docs, items)
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == want and len(want) >= 20
    whole = {i: set(brute_words(t)) for i, t in docs}
    assert all(r.similarity >= 0.8 and r.first_word >= 0 and whole[r.doc_id] for r in got)


def test_edited_items_are_found_down_to_the_least_similarity():
    """Items with single words changed, whole and cut off at the edges of a text."""
    rng, texts, want = random.Random(11), [], []
    unlike = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    items = [(i, unlike(59 + 40 * (i % 4))) for i in range(40)]
    probes = decontam.Probes.build(items, len(items), {})
    for i, text in items:
        words = text.split()
        n, changed = len(words), max(1, (len(words) - 4) // 50)
        for at in rng.sample(range(5, n - 5, 12), changed):
            words[at] = "changed"
        # Each changed word takes five shingles of the item and adds five.
        if (n - 4 - 5 * changed) / (n - 4 + 5 * changed) >= 0.8:
            texts.append(f"{unlike(30)} {' '.join(words)} {unlike(30)}")
            want.append(i)
        cut = text.split()[: n - n // 8]
        texts += [f"{unlike(30)} {' '.join(cut)}", " ".join(cut), f"{' '.join(text.split()[n // 8 :])} {unlike(30)}"]
        want += [i] * 3
    got = decontam._matches(probes, texts)
    assert sorted(got) == list(enumerate(want)) and len(want) >= 140
    assert min(v[0] for v in got.values()) < 0.86


def test_every_fingerprint_within_the_radius_is_found():
    """By the index, as by comparing them all; only items of the window's size."""
    rng = np.random.default_rng(5)
    items = [(i, prose(3000 + i, 30 + i % 3)) for i in range(60)]
    probes = decontam.Probes.build(items, len(items), {})
    flips = [sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in range(0, 40) for _ in range(20)]
    windows = np.array([int(probes.fingerprints[i % 60]) ^ f for i, f in enumerate(flips)], "<u8")
    for size in (26, 27, 28):
        window, item = probes.within_radius(size, windows)
        got = set(zip(window.tolist(), item.tolist(), strict=True))
        want = {(w, i) for w in range(len(windows)) for i in range(60) if probes.sizes[i] == size and (int(windows[w]) ^ int(probes.fingerprints[i])).bit_count() <= decontam.RADIUS}
        assert got == want and len(want) > 100


def test_fingerprints_are_sums_of_weighted_shingles():
    text = prose(1, 40) + " " + prose(1, 12)
    probes = decontam.Probes.build([(1, text), (2, prose(2, 30))], 2, {})
    h = decontam.shingles_of(decontam.word_hashes(decontam.words_of(text)))
    sums = np.zeros(64)
    for row in decontam._signed_bits(h, np.full(len(h), probes.default_weight)):
        sums += row
    assert int(probes.fingerprints[0]) == sum(1 << b for b in range(64) if sums[b] > 0)


def test_of_equal_windows_the_first_is_given(spark):
    item = prose(1, 30)
    got = decontam.leaks(spark.createDataFrame([(1, f"{prose(2, 20)} {item} {prose(3, 20)} {item}", "en", "web", 0)], DOCS), spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.n_words, r.similarity) for r in got] == [(1, 7, 20, 30, 1.0)]


@pytest.mark.parametrize("part_chars", [200, 1_000_000])
def test_parts_of_the_benchmark_find_the_same(spark, monkeypatch, part_chars):
    docs, items = planted()
    monkeypatch.setattr(decontam, "PART_CHARS", part_chars)
    clean = decontam.without_leaks(spark.createDataFrame([(i, t, "en", "web", 0) for i, t in docs], DOCS), spark.createDataFrame(items, ITEMS))
    leaking = {d for d, _ in brute_leaks(docs, items)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - leaking)


def test_pieces_of_a_long_text_overlap(monkeypatch):
    docs, items = planted()
    whole = decontam.Probes.build(items, len(items), {})
    text = "\n".join(t or "" for _, t in docs)
    want = decontam._matches(whole, [text])
    monkeypatch.setattr(decontam, "PIECE_WORDS", 64)
    assert decontam._matches(whole, [text]) == want and want


def test_messy_rows_and_empty_tables(spark, messy, no_docs):
    items = spark.createDataFrame([(None, None), (1, ""), (2, prose(2, 80)), (2, prose(2, 80))], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert {r.doc_id for r in decontam.leaks(messy, items).collect()} == {4, 5}
    clean = decontam.without_leaks(messy, items)
    assert clean.columns == messy.columns and clean.count() == messy.count() - 2
    assert decontam.leaks(messy, none).count() == 0 and decontam.without_leaks(messy, none).count() == messy.count()
    assert decontam.leaks(no_docs, items).count() == 0
