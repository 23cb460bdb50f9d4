"""Records on a stream: the same checks, as they need no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.records import parse_tool_calls


def stream_tool_calls(spark: SparkSession, path: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """Tool calls from files of JSON lines that arrive below a path."""
    return parse_tool_calls(spark.readStream.text(path).withColumnRenamed("value", "text"), "text", allowed)
