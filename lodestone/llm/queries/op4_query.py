"""op4_decontamination: the benchmark items that ``documents`` contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.decontam import leaks


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document and item, of leaking documents only."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
