from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid

from .conftest import DOCS


def brute_phrases(reference: str, text: str) -> int:
    """Greedy phrases, each the longest match with the reference (one character where none matches)."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in reference:
            n += 1
        count, at = count + 1, at + n
    return count


def speech(seed: int, n: int, syllables: str) -> str:
    rng = random.Random(seed)
    parts = syllables.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


TONGUES = {"aa": "th er on an re he in ed nd ha", "bb": "ei ch en sch un ge ie ber te zu", "cc": "é eau oi ou que tion le la des ai"}


def brute_identify(references: dict[str, str], text: str | None) -> tuple[str, float]:
    own = langid.normalized(text)
    if not own or not references:
        return "und", 0.0
    costs = sorted((brute_phrases(r, own) * math.log2(max(2, len(r))), x) for x, r in references.items())
    return costs[0][1], 1 - costs[0][0] / costs[1][0] if len(costs) > 1 else 1.0


@pytest.mark.parametrize("segment", [1, 3, 16, 256])
def test_phrases_equal_a_plain_parse_of_the_whole_text(monkeypatch, segment):
    """Whatever the segments are, and whatever characters the references have."""
    monkeypatch.setattr(langid, "SEGMENT", segment)
    references = {x: speech(i, 200, s) for i, (x, s) in enumerate(TONGUES.items())}
    references["ideographs"] = "".join(chr(0x4E00 + i * 7 % 900) for i in range(1200))
    parser = langid.Parser.build(references)
    texts = [speech(seed, 1 + seed * 9, list(TONGUES.values())[seed % 3]) for seed in range(14)]
    texts += ["x", "", references["aa"], references["aa"][7:900] * 2, references["ideographs"][100:500] + "th er", "\u4e00\ud55c" * 40]
    got = np.concatenate([c / parser.log_lengths for c in parser.costs(texts)])
    want = [[brute_phrases(references[x], t) for x in parser.languages] for t in texts]
    assert got.round(6).tolist() == want


def test_predictions_equal_a_plain_parse(spark, spoken, monkeypatch):
    """Sampling aside, the whole operator; also with a table for each language."""
    learnt = spoken.where(~langid.held_out())
    found = langid.references(langid.sample_rows(learnt))
    docs = spoken.where("doc_id % 5 = 0").select("doc_id", "text")
    want = {r.doc_id: brute_identify(found, r.text) for r in docs.collect()}
    for size in (32, 1):
        monkeypatch.setattr(langid, "GROUP", size)
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, learnt).collect()}
        assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
        assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_many_scripts_and_languages_are_learnt(spark):
    """Each language has letters of its own, more than a byte could number."""
    own = lambda k, i: "".join(chr(0x4E00 + 200 * k + (i * 37 + j * 11) % 200) for j in range(60))
    rows = [(40 * k + i, own(k, i), f"l{k:02d}", "web", 0) for k in range(40) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs, docs.where("doc_id % 6 <> 0")).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred <> lang").count() == 0


def test_letters_and_marks_are_kept_and_other_numerals_are_not():
    assert [langid.normalized(t) for t in ("\u00bd \u00b2\u00b3 \u2167 42", "\u0301", None, "A-1 b_C")] == ["", "", "", "a b c"]
    assert langid.normalized("\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e") == "\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e"


def test_ties_go_to_the_first_language_by_name(spark):
    rows = [(i, speech(5, 40, TONGUES["aa"]), x, "web", 0) for i, x in enumerate(("zz", "mm", "kk"))]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.lang_pred for r in langid.identify(docs, docs).collect()} == {"kk"}


def test_an_automaton_accepts_all_substrings_and_no_others():
    rng = random.Random(1)
    for _ in range(40):
        word = [rng.randint(1, 3) for _ in range(rng.randint(0, 14))]
        move = langid.suffix_automaton(word)

        def accepts(part, move=move):
            state = 0
            for c in part:
                if c not in move[state]:
                    return False
                state = move[state][c]
            return True

        own = {tuple(word[i:j]) for i in range(len(word)) for j in range(i, len(word) + 1)}
        assert all(map(accepts, own))
        assert not any(accepts(p) for p in (tuple(rng.randint(1, 3) for _ in range(4)) for _ in range(60)) if p not in own and p)


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, speech(1000 + i, 20 + i % 50, s), x, "web", 0) for i in range(360) for k, (x, s) in enumerate(TONGUES.items()) if i % 3 == k]
    return spark.createDataFrame(rows, DOCS)


def test_held_out_accuracy(spoken):
    got = langid.identify(spoken, spoken.where(~langid.held_out())).join(spoken.where(langid.held_out()), "doc_id")
    assert got.count() > 40
    assert got.where("lang_pred = lang").count() >= 0.99 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_predictions_do_not_read_labels(spark, spoken):
    changed = spoken.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    learnt = spoken.where(~langid.held_out())
    assert langid.identify(spoken, learnt).exceptAll(langid.identify(changed, learnt)).count() == 0


def test_whole_texts_are_read(spark, spoken):
    parser = langid.Parser.build(langid.references(langid.sample_rows(spoken)))
    mixed = speech(1, 400, TONGUES["aa"]) + " " + speech(2, 40_000, TONGUES["bb"])
    assert [p[0] for p in parser.best([langid.normalized(mixed)])] == ["bb"]


def test_messy_rows_and_empty_tables(messy, no_docs, spoken):
    rows = langid.identify(messy, spoken).collect()
    assert len(rows) == messy.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (4, 5)}) == 1
    assert {r.lang_pred for r in langid.identify(messy, no_docs).collect()} == {"und"}
    assert langid.identify(no_docs, spoken).count() == 0
