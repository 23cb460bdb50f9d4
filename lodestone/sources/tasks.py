"""Task manifests: JSON files with one object each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.records import task_error, task_text


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text, error) of each manifest below a path; good ones have a text, others an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("record"))
    judged = files.withColumn("error", task_error(F.col("record")))
    return judged.select("file", "record", F.when(F.col("error").isNull(), task_text(F.col("record"))).alias("text"), "error")
