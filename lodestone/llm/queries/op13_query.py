"""op13_embedding_whitening: all usable rows of ``embeddings`` on their first four whitened components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.whitening import whiten


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


#: Eigenvectors have no SQL; tests hold the query against a dense solver.
QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
