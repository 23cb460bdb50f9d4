"""op12_hard_negatives: anchors of ``embeddings`` with the negatives of each of their positives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table
from lodestone.llm.negatives import LEAST, NEGATIVES, POSITIVES, hard_negatives, labelled_vectors
from lodestone.llm.vectors import STEPS

ANCHORS, RELABEL, CLASSES = 100, 7, 10


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(labelled_vectors(table(spark, sf_dir, "embeddings"), RELABEL, CLASSES), "negatives-rows")
    return hard_negatives(rows, rows.where(F.col("id") % ANCHORS == 0))


ORACLE_SQL = {
    "op12_hard_negatives": f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {CLASSES} ELSE label END AS label,
         list_transform(embedding, lambda c: floor({STEPS} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id, label, x) AS rid FROM v),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % {ANCHORS} = 0),
p AS (
  SELECT anchor, anchor_id, rid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id, s.rid)::INTEGER AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND {LEAST} * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
