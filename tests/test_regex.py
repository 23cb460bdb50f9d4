"""Python's searches in Spark, held against ``re.search`` itself."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import regex
from lodestone.operators import files as files_ops

LINES = [
    "", " ", "café au lait", "ÉTÉ", "été", "Straße", "STRASSE", "İstanbul", "ıssız", "٣٤٥ items", "x² and ½", "中文 text", "naïve_name = 1",
    "foo bar", "foofoo", "foo\r", "tab\there", "nbsp here", "a\x1cb", "line sep", "end.", "the end.", "éthe x.", "thé x.", "Kelvin K", "ſharp", "ΣΑΣ σας ς",
    "aaa", "aaab", "abab", "ab" * 3000, "x" * 5000, "def f(x): return x", "async  def g", "class C:", "1 2 3 4", "a-b_c", "$money^", "tail \\", "[brackets]", "\U0001f600 smile", "١٢", "été",
    "DŽ ǅ ǆ", "user@example.com", "2024-01-02", "  indented", "trailing  ", "MiXeD CaSe", "q\u0085q", "CRLF\r\nnext", "two\nlines", "two\n", "\n", "a.b", "µ and μ", "ﬁ ligature", "°C",
]
PATTERNS = [
    r"^\w+$", r"\w+ \w+", r"\d", r"\d{3}", r"\D\D", r"\s", r"\S\s\S", r"\W", r"^\W*$", r"\bthe\b.*\.", r"\bthe\b", r"\Bfoo", r"foo\B", r"\B", r"\b", r"(?i)été", r"(?i)ÉTÉ", r"(?i)straße", r"(?i)k", r"(?i)s", r"(?i)[a-z]+x",
    r"(?i)[^k]$", r"(?i)i", r"(?i)σ", r"(?i)ǆ", r"(?i)µ", r"(?P<n>foo)(?P=n)", r"(foo)\1", r"(a)(b)\1\2", r"(?P<year>\d{4})-(?P<m>\d\d)", r"foo\Z", r"\Afoo", r"foo$", r"^foo", r"(?m)^next", r"(?m)two$", r"(?m)^$", r"\n$", r"(?s)two.lines", r"two.lines",
    r"(?a)^\w+$", r"(?a)\d", r"(?a)\bthe\b", r"(?ai)k", r"(?i:CAFÉ) au", r"(?i:caf)É", r"[\w.]+@[\w.]+", r"[^\W\d_]+", r"[\s\d]", r"[^\s]\s$", r"[^a-z]", r"[\]\[]", r"[a\-z]b", r"\$\w+\^", r"\\$", r"a{2,3}b", r"a+?b", r"a*+b", r"(?>a+)b", r"(?=.*foo)bar", r"(?<=foo )bar", r"(?<!foo )bar",
    r"foo(?! )", r"(?:foo|bar)$", r"(?:ab)+$", r"(?:\w\s)+x", r"(a)?b(?(1)b|a)", r"(?i)(foo)\1", r"(?:(a)|b)*\1", r"x{5000}", r"(?x) foo \s  bar # words", r"é", r"\x41|\N{GREEK SMALL LETTER SIGMA}", r"[٠-٩]", r"中|naïve", r"\.$", r"", r"a|", r"[^\n]*$", r"(?:ab){2,4}$", r"^.$",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "i int, x string").cache()


def test_patterns_find_what_python_finds(spark, lines):
    got = lines.orderBy("i").select(*[regex.searched(F.col("x"), p).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).collect()
    wrong = [(p, x) for k, p in enumerate(PATTERNS) for x, row in zip(LINES, got, strict=True) if row[k] != (re.search(p, x) is not None)]
    assert wrong == []


def test_most_patterns_run_in_the_jvm():
    left = []
    for p in PATTERNS:
        try:
            regex.to_java(p)
        except regex.Untranslatable:
            left.append(p)
    assert left == [r"(?:ab)+$", r"(?:\w\s)+x", r"(a)?b(?(1)b|a)", r"(?i)(foo)\1", r"(?:(a)|b)*\1"]


def test_every_character_is_of_the_same_kind(spark):
    """Of all assigned characters that both Unicode versions know."""
    import unicodedata

    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    df = spark.createDataFrame([(chr(p),) for p in points[::7] + list(range(0x600))], "x string")
    rows = df.select("x", *[regex.searched(F.col("x"), p).alias(n) for n, p in (("w", r"^\w$"), ("d", r"^\d$"), ("s", r"^\s$"), ("dot", "^.$"))], F.expr(r"x rlike '^\\p{Cn}$'").alias("new")).collect()
    kinds = {"w": r"^\w$", "d": r"^\d$", "s": r"^\s$", "dot": "^.$"}
    assert [r.x for r in rows for n, p in kinds.items() if not r.new and r[n] != (re.search(p, r.x) is not None)] == []


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "x string")
    assert [tuple(r) for r in df.select(regex.searched(F.col("x"), "a"), regex.searched(F.col("x"), "(?:ab)+$")).collect()] == [(None, None)]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_requirements_hold_where_the_pattern_is_found(pattern):
    def holds(need, low):
        if need is None or isinstance(need, str):
            return need is None or need in low
        return (all if need[0] == "all" else any)(holds(n, low) for n in need[1])

    need = regex.required(pattern)
    assert [x for x in LINES if re.search(pattern, x) and not holds(need, x.lower())] == []


def test_requirements():
    assert regex.required(r"\bthe\b.*\.") == ("all", ["the", "."])
    assert regex.required("(?:foo|Bar)x") == ("all", [("any", ["foo", "bar"]), "x"])
    assert regex.required("(foo)?bar+") == ("all", ["ba", "r"])
    assert regex.required("(?i)mask") == ("all", ["ma", "k"])
    assert regex.required(r"\d+") is None


def test_grep_as_python_searches(spark):
    files = spark.createDataFrame([("a.md", "café noir\nl'été\nfoofoo\n"), ("b.md", None), ("c.bin", "café"), ("d.py", "٣\r\nx")], "path string, content string")
    found = lambda p: [(r.path, r.line_no) for r in files_ops.grep(files, p).orderBy("path", "line_no").collect()]
    assert found(r"^\w+ \w+$") == [("a.md", 1)]
    assert found(r"(?i)ÉTÉ") == [("a.md", 2)]
    assert found(r"(?P<n>foo)(?P=n)") == [("a.md", 3)]
    assert found(r"^\d$") == [("d.py", 1)]
    assert found(r"(?:fo*)+$") == [("a.md", 3)]
