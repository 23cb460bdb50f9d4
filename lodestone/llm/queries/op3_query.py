"""op3_simhash_near_dedup: fingerprints and components of all of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.simhash import near_duplicates


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_duplicates(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
