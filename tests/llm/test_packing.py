"""Operator 11 against the tokenizer itself and a plain version of the rule."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import packing
from lodestone.llm.queries.op11_query import TOKENIZER, op11_packing

from .conftest import DOCS, messy_rows, prose

P = pytest.importorskip("public_tokenizers")

ODD = ["", "  lead", "İstanbul ΣΑΣ ςΣ. don't <|endoftext|>x a\x1cb \x85 \xa0 é ́x 中文 ² ½ x y I'LL 'S ''s ..'s", "x" * 3000, "ｆｕｌｌ　width éÉ´´ ﬁ ǅ ſ K Å", "\x0b\x0c\n ", "it's they'LL we've", "a,b;c 12345 x1y2 __ --", "naïve Straße ß ŉ", "<|startoftext|>", "\U0001f600\U0001f600 ok"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(TOKENIZER))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rng = random.Random(5)
    letters = "abcXYZéÉßñÑüÜøŒœŁł'’.,;-0123456789²½ \t\n#$%"
    texts = ODD + [r[1] for r in messy_rows()] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    encoder = packing.Encoder(P.path(TOKENIZER), packing.END_ID)
    assert encoder.apart
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.documents(pa.array(texts, pa.string()))]
        assert got == [ids_of(tokenizer, t) for t in texts]


def test_what_is_kept_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    encoder = packing.Encoder(P.path(TOKENIZER), packing.END_ID)
    for text in ("one two three four", "five six seven eight nine ten", "中 文 字 一 二 三", "one"):
        assert next(encoder.documents(pa.array([text]))) == np.array(ids_of(tokenizer, text), "<u4").tobytes()
    assert len(encoder.pieces) <= 5 and len(encoder.seen) <= 6


def test_another_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer

    name = "byte_bpe_50k.json"
    encoder, own = packing.Encoder(P.path(name), 9), Tokenizer.from_file(P.path(name))
    assert not encoder.apart
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.documents(pa.array([" a  b\n", None]))] == [[*own.encode(" a  b\n", add_special_tokens=False).ids, 9], [9]]


def plain_level(counts: list[int], window: int, spare: int, size: int) -> int:
    """The rule, by trying every level."""
    best = None
    for level in range(window - size + 1):
        if level and not counts[level]:
            continue
        after = list(counts)
        if level:
            after[level] -= 1
        if level + size < window - spare:
            after[level + size] += 1
        key = (sum(n * n for n in after[1:window]), -level)
        best = min(best, (key, level)) if best else (key, level)
    return best[1]


@pytest.mark.parametrize("spare", [0, 3])
def test_levels_are_those_of_the_rule(spare):
    rng = random.Random(11)
    window = 32
    packer = packing.Packer(window, 10**6, spare)
    for i in range(600):
        size = rng.choice((rng.randint(1, window - 1), 7, 9, 16))
        counts = packer.counts.tolist()
        assert packer.level_for(size) == plain_level(counts, window, spare, size)
        list(packer.place(packing.Piece(i, 0, bytes(4 * size), size)))
        assert packer.counts.tolist() == [len(packer.open.get(level, [])) for level in range(window + 1)]
        assert sum(packer.counts) == packer.n_open


def checked(rows, texts: dict, tokenizer, window: int) -> list[int]:
    """Every id in one piece, no gap, no sequence too long; the lengths of the sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids, at = ids_of(tokenizer, texts[doc_id]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return [sum(r.length for r in own) for own in by_sequence.values()]


def test_documents_of_all_lengths(spark, tokenizer):
    rng = random.Random(2)
    texts = {i: prose(i, rng.choice((1, 30, 200, 900, 3000))) for i in range(60)} | {100: None, 101: "", 102: "x" * 40_000}
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in texts.items()], DOCS).repartition(3)
    pieces = packing.packed(docs, P.path(TOKENIZER), window=256, most_open=4, spare=0).withColumn("ids_crc32", F.crc32("ids"))
    lengths = checked(pieces.collect(), texts, tokenizer, 256)
    assert all(n & (n - 1) == 0 for n in lengths)

    whole = packing.sequences(pieces.cache(), 256).collect()
    assert sorted(r.length for r in whole) == sorted(lengths) and {r.padding for r in whole} == {0}
    assert all(len(r.ids) == 4 * r.length == 4 * sum(r.lengths) and len(r.doc_ids) == len(r.lengths) for r in whole)


def test_documents_are_cut_only_where_windows_close(spark, tokenizer):
    """Pieces of windows that filled up are whole documents; few are cut by the closing ones."""
    docs = spark.createDataFrame([(i, prose(i, 20 + i % 97), "en", "web", 0) for i in range(800)], DOCS).coalesce(1)
    chopped = sum(r.length for r in packing.packed(docs, P.path(TOKENIZER), window=1024).collect()) // 1024
    rows = packing.packed(docs, P.path(TOKENIZER), window=1024).select("doc_id", "start", "length", "doc_tokens").collect()
    cut = {r.doc_id for r in rows if r.length < r.doc_tokens}
    # Laying all documents end to end would cut one at nearly every window.
    assert len(cut) < 0.5 * chopped
    again = packing.packed(docs, P.path(TOKENIZER), window=1024).select("doc_id", "start", "length", "doc_tokens").collect()
    assert rows == again


def test_padding_where_a_sequence_is_no_power_of_two(spark):
    rows = [(1, 0, 3, b"abcdefghijkl", 3, 7, 0), (2, 0, 2, b"mnopqrst", 2, 7, 3), (3, 0, 4, bytes(16), 4, 8, 0)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    got = {r.sequence_id: r for r in packing.sequences(df, 8).collect()}
    assert (bytes(got[7].ids), got[7].lengths, got[7].doc_ids, got[7].padding, got[8].padding) == (b"abcdefghijklmnopqrst", [3, 2], [1, 2], 3, 0)


def test_messy_rows_and_empty_tables(messy, no_docs, tokenizer):
    rows = packing.packed(messy, P.path(TOKENIZER)).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(tokenizer, r[1])) for r in messy_rows())
    assert sorted({(r.doc_id, r.doc_tokens) for r in rows if r.doc_id in (1, 2, 3)}) == [(1, 1), (2, 1), (3, 1)]
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * len(ids_of(tokenizer, prose(3, 80)))
    assert packing.packed(no_docs, P.path(TOKENIZER)).count() == 0


def test_the_query(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    lengths = checked(op11_packing(spark, "/root/testdata/sf0.001").collect(), texts, tokenizer, packing.WINDOW)
    assert all(n & (n - 1) == 0 or n >= packing.WINDOW - packing.SPARE for n in lengths)
