"""op7_warc_round_trip: all of ``pages`` written as WARC and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.warc import REVISIT_BYTES, warc_round_trip


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = {
    "op7_warc_round_trip": f"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts"""
}
QUERIES = {"op7_warc_round_trip": op7_warc_round_trip}
