"""Queries and oracle SQL of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: The modules that offer QUERIES (and, where SQL can say it, ORACLE_SQL).
MODULES = ("op1_query", "op2_query", "op3_query", "op4_query", "op5_query", "op6_query", "op7_query", "op8_query", "op9_query", "op10_query", "op11_query", "op12_query", "op13_query")


def _load() -> list:
    return [import_module(f"lodestone.llm.queries.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _load() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _load() for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
