"""Files as chunk rows: the results of whole texts, wherever they are cut."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunks
from lodestone.operators import files as files_ops
from lodestone.operators.retrieve import retrieve, score_files
from lodestone.sources.repo import scan_chunks, scan_repo

from .test_files import write

FILES = "path string, content string"
TEXTS = [
    "aaa aaaa\r\n\r\naa\rb\n\nc", "def the(x):\n  async  def\u00a0 the():\n", "banana anana ana the, THE!", "\n", "\r\n", "a\r", "", "x", "one line without end", "\u2028a\x0bb\x1cc\x85d", "été the\n中文中文中 42 424242!",
    "classthe class the class\tthe", "!!! ... ,,,", "e\u0301the the\u0301 the", "İ def the. def\n\n\n\nthe", "\U0001f600the\U0001f600\n\U0001f600",
]
QUERY = "aa the ana The 42 中文 a def"


@pytest.fixture(scope="module")
def cut(spark):
    """(files, chunks): each text once for every size of part."""
    whole, parts = [], []
    for i, text in enumerate(TEXTS):
        for size in range(1, max(2, len(text) + 1)):
            path = f"t{i}/{size}.py"
            whole.append((path, text))
            parts += [(path, k, text[at : at + size]) for k, at in enumerate(range(0, max(1, len(text)), size))]
    whole.append(("none.md", None))
    parts.append(("none.md", 0, None))
    files = spark.createDataFrame(whole, FILES).repartition(4).cache()
    return files, spark.createDataFrame(parts, "path string, part int, content string").repartition(4).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lines(cut):
    got = {}
    for path, number, line in rows(chunks.lines(cut[1])):
        got.setdefault(path, {})[number] = line
    for path, text in cut[0].collect():
        own = got.get(path, {})
        assert [own[k] for k in sorted(own)] == (text or "").splitlines() and sorted(own) == list(range(1, len(own) + 1)), path


def test_grep(cut):
    for pattern in (r"\bthe\b", "^$", "a$", "(?:a|b)+c?$"):
        assert rows(chunks.grep(cut[1], pattern)) == rows(files_ops.grep(cut[0], pattern))


def test_scores(cut):
    got = {r.path: round(r.score, 9) for r in chunks.score(cut[1], QUERY).collect()}
    want = {r.path: round(r.score, 9) for r in score_files(cut[0], QUERY).collect()}
    assert got == want
    assert rows(chunks.retrieve(cut[1], "the banana", 7)) == rows(retrieve(cut[0], "the banana", 7).select("path", "score"))
    assert {r.score for r in chunks.score(cut[1], "").collect()} == {0.0}


def test_a_table_is_cut(spark, cut):
    files = spark.createDataFrame([("a.md", "0123456789"), ("b.md", ""), ("c.md", None), ("d.md", "\U0001f600é")], FILES)
    assert rows(chunks.chunked(files, 4)) == [("a.md", 0, "0123"), ("a.md", 1, "4567"), ("a.md", 2, "89"), ("b.md", 0, ""), ("c.md", 0, None), ("d.md", 0, "\U0001f600é")]
    assert rows(chunks.chunked(files, 1).where("path = 'd.md'")) == [("d.md", 0, "\U0001f600"), ("d.md", 1, "é")]


def test_no_value_is_larger_than_a_part(cut):
    small = cut[1].where("path like 't10/3.py'")
    assert small.agg(F.max(F.length("content"))).first()[0] == 3


@pytest.mark.parametrize("chars", [1, 2, 3, 7, 1000])
def test_a_tree_in_parts(spark, tmp_path, chars):
    data = {"a.py": b"x\r\ny\rz\xff\xc3\xa9 the\n", "d/b.md": "é\U0001f600 the the".encode(), "empty.txt": b"", ".h/c.md": b"\r\n\r\n"}
    write(tmp_path, data)
    (tmp_path / "link.md").symlink_to(tmp_path / "a.py")
    parts, whole = scan_chunks(spark, str(tmp_path), chars), scan_repo(spark, str(tmp_path))
    assert max(len(r.content) for r in parts.collect()) <= chars
    texts = {}
    for r in parts.orderBy("path", "part").collect():
        texts[r.path] = texts.get(r.path, "") + r.content
    assert texts == {r.path: r.content for r in whole.collect()}
    assert rows(chunks.grep(parts, "the|^$")) == rows(files_ops.grep(whole, "the|^$"))
    assert rows(scan_chunks(spark, str(tmp_path), chars).where("path = 'd/b.md'").select("path").distinct()) == [("d/b.md",)]
