"""op5_language_id: the language of all of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.langid import held_out, identify


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = docs.where(~held_out()).select("doc_id", "text", "lang")
    return identify(docs, learnt).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
