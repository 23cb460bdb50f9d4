"""The training-data pipeline over ``documents``: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Other tables come from sf_dir.

Defined results: a row with null or empty text has no words, so the first stage
drops it; rows are judged one by one, so null and repeated ids are no special
case: of rows that repeat a text one stays, the least by id (null last), text and
then all other columns; of passages that repeat the first stays; ties in the last
stage follow its own order; empty tables give an empty result; further columns
pass through to the last stage, whatever their names, which returns its own.
``n_chars`` follows a text that was cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import materialize, table
from lodestone.llm.decontam import without_leaks
from lodestone.llm.linededup import without_passages
from lodestone.llm.mixing import mixed_documents
from lodestone.llm.quality import keep_good
from lodestone.llm.simhash import keep_one

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; ``n_chars`` follows the text that is left."""
    return without_passages(docs, length="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of each document that is left."""
    return mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", mixing),
]

#: SimHash fingerprints and window searches have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
