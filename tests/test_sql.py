"""Table functions of SQL and the sink of trees."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.operators import files as files_ops
from lodestone.operators.retrieve import retrieve, score_files
from lodestone.operators.symbols import symbols
from lodestone.plans import table_functions
from lodestone.sources.repo import scan_repo, write_tree

FILES = "repo string, path string, content string"
ROWS = [
    ("a", "x/one.py", "class A:\n    def f(self): pass\nneedle = 1\n"), ("a", "two.md", "needle\r\nother needle\n\nété needle"), ("a", "no.bin", "needle"), ("b", "three.txt", "the needle the"),
    ("b", "bad.py", "def ("), ("b", "none.md", None), ("b", "empty.md", ""), (None, "four.md", "needle the needle"),
]


@pytest.fixture(scope="module")
def files(spark):
    table_functions.register(spark)
    return spark.createDataFrame(ROWS, FILES).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_grep_in_sql(spark, files):
    for pattern in ("needle", r"^\w+ needle$", "nothing"):
        got = spark.sql("SELECT path, line_no, line FROM grep_files(TABLE({files}), {p}) WHERE error IS NULL", files=files, p=pattern)
        assert rows(got) == rows(files_ops.grep(files, pattern))


def test_symbols_in_sql(spark, files):
    assert rows(spark.sql("SELECT * FROM file_symbols(TABLE({files}))", files=files)) == rows(symbols(files))


def test_the_best_files_of_each_partition(spark, files):
    got = spark.sql("SELECT path, rank, score FROM best_files(TABLE({files}) PARTITION BY (repo), 'needle The', 1)", files=files).collect()
    want = [retrieve(files.where(F.col("repo").eqNullSafe(repo)), "needle The", 1).first() for repo in ("a", "b", None)]
    assert sorted((r.path, r.rank, round(r.score, 9)) for r in got) == sorted((r.path, 1, round(r.score, 9)) for r in want)
    one = spark.sql("SELECT path FROM best_files(TABLE({files}) WITH SINGLE PARTITION, 'needle the', 3)", files=files).collect()
    assert [r.path for r in one] == [r.path for r in retrieve(files, "needle the", 3).collect()]


def test_scores_in_sql(spark, files):
    got = spark.sql("SELECT * FROM file_scores(TABLE({files}), 'needle The')", files=files)
    assert got.columns == ["repo", "path", "score", "error"]
    want = score_files(files, "needle The").where("score > 0").select("repo", "path", F.round("score", 9), F.lit(None))
    assert rows(got.select("repo", "path", F.round("score", 9), "error")) == rows(want)
    assert rows(spark.sql("SELECT * FROM file_scores(TABLE({files}), '?')", files=files)) == []
    with pytest.raises(Exception, match="a column of the result's name: score"):
        spark.sql("SELECT * FROM file_scores(TABLE({files}), 'x')", files=files.withColumn("Score", F.lit(1))).collect()


def test_best_files_of_large_partitions_send_no_texts(spark, tmp_path):
    """All but the best two of a partition stay in the tasks that read them."""
    text = F.concat(F.repeat(F.lit("the "), (F.col("id") % 7 + 1).cast("int")), F.repeat(F.lit("x"), 5000))
    docs = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.sql_best_files(spark, str(tmp_path))
    assert [r.path for r in found.orderBy("rank").collect()] == ["s/en/342.md", "s/en/242.md"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning")[1]
    assert "Partial" in below and "WindowGroupLimit" in below and plan.count("Exchange ") == 1


def test_errors_are_rows(spark, files):
    for pattern, said in (("[", "Invalid regex: "), ("", "grep requires a non-empty pattern.")):
        got = spark.sql("SELECT * FROM grep_files(TABLE({files}), {p})", files=files, p=pattern).collect()
        assert got and all(r.path is None and r.error.startswith(said) for r in got)
    assert {r.error for r in spark.sql("SELECT * FROM best_files(TABLE({files}) WITH SINGLE PARTITION, 'x', 0)", files=files).collect()} == {"top_k must be >= 1."}
    with pytest.raises(Exception, match="table with path and content"):
        spark.sql("SELECT * FROM grep_files(TABLE({files}), 'x')", files=files.drop("content")).collect()


def test_a_tree_is_written_and_read_back(spark, tmp_path):
    data = [(f"d{i % 7}/e{i % 3}/f{i}.txt", f"text {i}\n") for i in range(60)] + [("top.md", "é\n"), (".hidden/__init__.py", "")]
    df = spark.createDataFrame(data, "path string, content string").repartition(5)
    write_tree(df, str(tmp_path / "new" / "tree"))
    assert rows(scan_repo(spark, str(tmp_path / "new" / "tree"))) == sorted(data, key=str)
    assert os.listdir(tmp_path / "new") == ["tree"]
    with pytest.raises(Exception, match="this one is taken"):
        write_tree(df, str(tmp_path / "new" / "tree"))
    binary = spark.createDataFrame([("b.bin", b"\x00\xff")], "path string, content binary")
    write_tree(binary, str(tmp_path / "bytes"))
    assert (tmp_path / "bytes" / "b.bin").read_bytes() == b"\x00\xff"


@pytest.mark.parametrize("bad", [("../evil.txt", "x"), ("/etc/evil", "x"), ("a//b", "x"), ("", "x"), (None, "x"), ("null.txt", None), ("d/0.txt", "twice"), ("d", "a folder elsewhere")])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    df = spark.createDataFrame([(f"d/{i}.txt", "x") for i in range(20)] + [bad], "path string, content string").repartition(4)
    with pytest.raises(Exception):
        write_tree(df, str(tmp_path / "tree"))
    assert os.listdir(tmp_path) == []


def test_no_link_is_followed(spark, tmp_path):
    (tmp_path / "outside").mkdir()
    (tmp_path / "tree").symlink_to(tmp_path / "outside")
    with pytest.raises(Exception, match="this one is taken"):
        write_tree(spark.createDataFrame([("a", "x")], "path string, content string"), str(tmp_path / "tree"))
    assert os.listdir(tmp_path / "outside") == []
