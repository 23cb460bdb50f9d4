from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import linededup

from .conftest import DOCS, prose


def passage(seed: int) -> str:
    return "\n".join(prose(seed + i, 9) for i in range(12))


def dedup(spark, texts, divisor=linededup.DIVISOR):
    rows = [(i, t, "en", "web", 0) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS), divisor).collect()}


def test_a_repeated_passage_stays_once(spark):
    shared = passage(100)
    texts = [prose(i, 30) + "\n" + shared + "\n" + prose(50 + i, 30) for i in range(4)]
    got = dedup(spark, texts)
    assert got[0].text == texts[0] and got[0].n_removed_lines == 0
    for i in (1, 2, 3):
        assert got[i].n_removed_words == 12 * 9
        assert got[i].text == prose(i, 30) + "\n" + prose(50 + i, 30)


def test_short_passages_go_up_to_their_edges(spark):
    """51 to 80 words in 3 to 8 short lines, with 2 and with 9 sharers."""
    texts, want = [], []
    for n_lines, n_words in ((3, 17), (3, 18), (4, 13), (4, 15), (4, 19), (5, 11), (5, 16), (6, 9), (6, 13), (7, 8), (8, 7), (8, 10)):
        for sharers in (2, 9):
            seed = 10_000 * len(texts)
            shared = "\n".join(prose(seed + i, n_words) for i in range(n_lines))
            for k in range(sharers):
                around = ["\n".join(prose(seed + 100 * k + 1000 * side + i, 9) for i in range(4)) for side in (1, 2)]
                texts.append("\n".join([around[0], shared, around[1]]))
                want.append((texts[-1], 0) if k == 0 else ("\n".join(around), n_lines * n_words))
    got = dedup(spark, texts)
    assert [(got[i].text, got[i].n_removed_words) for i in range(len(texts))] == want


def test_the_first_place_keeps_its_lines(spark):
    line = prose(9, 15)
    assert dedup(spark, ["\n".join([line] * 5)])[0].text == f"{line}\n{line}"


def test_boundaries_resist_shifts(spark):
    lines = [prose(300 + i, 6) for i in range(120)]
    got = dedup(spark, ["\n".join(lines), "\n".join(["a new first line", *lines[:60], "an inserted line", *lines[60:]])])
    assert got[1].n_removed_lines == 120
    assert "a new first line" in got[1].text and "an inserted line" in got[1].text


def test_one_short_line_that_repeats_stays(spark):
    texts = [f"{prose(i, 25)}\nAll rights reserved.\n{prose(60 + i, 25)}" for i in range(5)]
    assert [r.text for _, r in sorted(dedup(spark, texts).items())] == texts


def test_a_long_line_is_a_chunk(spark):
    line = prose(7, 80)
    got = dedup(spark, [f"first\n{line}\nend a", f"second\n{line}\nend b"])
    assert got[1].text == "second\nend b" and got[1].n_removed_words == 80


def test_repeats_within_a_text(spark):
    line = prose(8, 60)
    assert dedup(spark, [f"{line}\nmiddle\n{line}"])[0].text == f"{line}\nmiddle"


def test_hash_hits_are_compared_by_bytes(spark):
    """A chunk whose hash is equal but whose text is not stays."""
    line = prose(4, 60)
    df = spark.createDataFrame([(line, line, "other"), (line, "other", line)], "text string, a string, b string")
    lines = linededup._line_structs(F.col("text"))
    runs = lambda first: F.size(linededup._runs(lines, linededup._windows(lines, 1), F.array(F.struct(F.lit(0).alias("idx"), F.col(first).alias("first_text")))))
    assert [tuple(r) for r in df.select(runs("a"), runs("b")).collect()] == [(1, 0), (0, 1)]


def test_fewer_chunks_find_less(spark):
    shared = passage(100)
    texts = [prose(i, 30) + "\n" + shared + "\n" + prose(50 + i, 30) for i in range(3)]
    some = dedup(spark, texts, divisor=3)[1]
    assert some.n_removed_words < 12 * 9 and some.text.startswith(prose(1, 30)) and some.text.endswith(prose(51, 30))


def test_many_runs_in_one_text_are_cut_in_linear_time(spark):
    """Every third line is new, so each repeat is a run of its own."""
    pairs = [f"{prose(70_000 + i, 12)}\n{prose(90_000 + i, 12)}" for i in range(1500)]
    got = dedup(spark, ["\n".join(pairs), "\n".join(f"{p}\nnew {i}" for i, p in enumerate(pairs))])
    assert got[1].text == "\n".join(f"new {i}" for i in range(1500)) and got[1].n_removed_lines == 3000


def test_names_of_the_counts_may_be_there_before(spark):
    rows = [(i, f"first {i}\n{prose(7, 80)}", 5, 6, 7) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed_lines int, n_lines int, n_chars int")
    out = linededup.dedup_lines(docs).orderBy("doc_id").collect()
    assert [(r.text, r.n_removed_lines, r.n_lines) for r in out] == [(rows[0][1], 0, 6), ("first 1", 1, 6)]
    kept = linededup.without_passages(docs, "n_chars").orderBy("doc_id")
    assert kept.columns == docs.columns
    assert [(r.text, r.n_removed_lines, r.n_chars) for r in kept.collect()] == [(rows[0][1], 5, 7), ("first 1", 5, 7)]


def test_messy_rows_and_empty_tables(messy, no_docs):
    out = linededup.dedup_lines(messy)
    assert out.columns == [*messy.columns, "n_removed_lines", "n_removed_words"]
    rows = out.collect()
    assert len(rows) == messy.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].text is None and by_id[2].text == ""
    # 4 and 5 hold the same long line; the rows of 6 are one document.
    assert by_id[4].text == "" or by_id[5].text == ""
    assert len({r.text for r in rows if r.doc_id == 6}) == 1 and by_id[6].text
    assert linededup.dedup_lines(no_docs).count() == 0
