"""op2_line_dedup: all of ``documents`` without passages that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.linededup import DIVISOR, LONG_LINE, PASSAGE_WORDS, ROLL, RUN_WORDS, dedup_lines

assert (ROLL, DIVISOR) == (2, 1)  # what the SQL below says


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_removed_lines", "n_removed_words", "text")


def line_dedup_sql(source: str = "documents", p: str = "ld") -> str:
    """CTEs, with names that begin with p, up to <p>_result: doc_id, counts and text."""
    return rf"""
{p}_split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source} WHERE text IS NOT NULL),
{p}_lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM {p}_split),
{p}_counted AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM {p}_lines),
{p}_worded AS (
  SELECT doc_id, i, w, row_number() OVER d - 1 AS k, lead(i) OVER d AS i2, lead(w) OVER d AS w2
  FROM {p}_counted WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
{p}_chunks AS (
  SELECT doc_id, k, 2 * k AS idx, i AS a, i AS b, ls[i + 1] AS chunk FROM {p}_worded JOIN {p}_split USING (doc_id) WHERE w >= {LONG_LINE}
  UNION ALL
  SELECT doc_id, k, 2 * k + 1, i, i2, array_to_string(ls[i + 1:i2 + 1], chr(10)) FROM {p}_worded JOIN {p}_split USING (doc_id)
  WHERE i2 IS NOT NULL AND (w < {LONG_LINE} OR w2 < {LONG_LINE})),
{p}_again AS (
  SELECT *, lag(k + 1 + idx % 2) OVER (PARTITION BY doc_id ORDER BY idx) AS upto FROM (
    SELECT *, row_number() OVER f AS nth, first_value(doc_id) OVER f AS first_doc, first_value(idx) OVER f AS first_idx
    FROM {p}_chunks WINDOW f AS (PARTITION BY chunk ORDER BY doc_id, idx))
  WHERE nth > 1 AND NOT (doc_id = first_doc AND idx % 2 = 1 AND idx = first_idx + 2)),
{p}_islands AS (
  SELECT doc_id, a, b, sum(CASE WHEN upto >= k THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM {p}_again),
{p}_spans AS (SELECT doc_id, island, min(a) AS a, max(b) AS b FROM {p}_islands GROUP BY doc_id, island),
{p}_runs AS (
  SELECT s.doc_id, s.a, s.b, count(*) AS n_lines, sum(w) AS n_words FROM {p}_spans AS s JOIN {p}_counted AS c ON c.doc_id = s.doc_id AND c.i BETWEEN s.a AND s.b
  GROUP BY s.doc_id, s.a, s.b HAVING sum(w) >= {PASSAGE_WORDS} OR (count(*) >= 2 AND sum(w) >= {RUN_WORDS})),
{p}_gone AS (SELECT doc_id, unnest(range(a, b + 1)) AS i FROM {p}_runs),
{p}_left AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM {p}_lines ANTI JOIN {p}_gone USING (doc_id, i) GROUP BY doc_id),
{p}_counts AS (SELECT doc_id, sum(n_lines) AS n_lines, sum(n_words) AS n_words FROM {p}_runs GROUP BY doc_id),
{p}_result AS (
  SELECT s.doc_id, coalesce(r.n_lines, 0)::BIGINT AS n_removed_lines, coalesce(r.n_words, 0)::BIGINT AS n_removed_words,
         CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
  FROM {source} AS s LEFT JOIN {p}_counts AS r USING (doc_id) LEFT JOIN {p}_left USING (doc_id))"""


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE_SQL = {"op2_line_dedup": f"WITH {line_dedup_sql()}\nSELECT * FROM ld_result"}
