"""op1_quality_rules: the quality rules over all of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.quality import ALPHA, DELTA, PATH, PENALTY, RULES, quality_rules

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*COLUMNS)


def features_sql(source: str = "documents") -> str:
    """CTEs up to ``feats``, over a relation with doc_id, text and lang."""
    return rf"""
words AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM {source}),
spread AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM words WHERE len(w) >= 4),
grams AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM spread),
twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
feats AS (
  SELECT words.doc_id, stratum, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(text, '[!?]'))::BIGINT AS n_marks,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN line_counts USING (doc_id) LEFT JOIN covered USING (doc_id))"""


def verdict_sql(source: str = "documents") -> str:
    """CTEs up to ``verdict``: the features with base_failed and kept."""
    steps = ",\n               ".join(f"CASE WHEN {RULES[rule][0]} > {cut} THEN {t} END" for t, (rule, cut) in enumerate(PATH))
    return rf"""{features_sql(source)},
agreed AS (
  SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL
  GROUP BY doc_id HAVING min(quality) = max(quality)),
stepped AS (
  SELECT *, least({steps}) AS step FROM feats),
evidence AS (
  SELECT stratum, doc_id, q, min(coalesce(step, {len(PATH)})) AS lo, max(coalesce(step, {len(PATH)})) AS hi
  FROM stepped JOIN agreed USING (doc_id) GROUP BY ALL),
counts AS (
  SELECT stratum, t, count(*) FILTER (q = 1) AS n_good, count(*) FILTER (q = 0) AS n_bad,
         count(*) FILTER (q = 1 AND lo <= t) AS n_false, count(*) FILTER (q = 0 AND hi <= t) AS n_caught
  FROM evidence, range(0, {len(PATH)}) AS r(t) GROUP BY stratum, t),
tails AS (
  SELECT *, CASE WHEN n_false < n_good * {ALPHA}::DOUBLE THEN
    list_sum(list_transform(range(0, n_false + 1), lambda i: exp(
      lgamma(n_good + 1.0) - lgamma(i + 1.0) - lgamma(n_good - i + 1.0)
      + i * ln({ALPHA}::DOUBLE) + (n_good - i) * ln(1 - {ALPHA}::DOUBLE)))) ELSE 1.0 END AS tail
  FROM counts),
gains AS (
  SELECT *, n_caught / greatest(n_bad, 1) - {PENALTY}::DOUBLE * n_false / greatest(n_good, 1) AS gain
  FROM (SELECT *, max(tail) OVER (PARTITION BY stratum ORDER BY t) AS worst FROM tails)
  WHERE worst <= {DELTA}::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM counts))),
policies AS (
  SELECT stratum, arg_max(t, (gain, -t)) AS policy FROM gains WHERE gain > 0 GROUP BY stratum),
verdict AS (
  SELECT s.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(step > policy, true) AS kept
  FROM stepped AS s LEFT JOIN policies AS p ON s.stratum IS NOT DISTINCT FROM p.stratum)"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL = {"op1_quality_rules": f"WITH {verdict_sql()}\nSELECT {', '.join(COLUMNS)} FROM verdict"}
