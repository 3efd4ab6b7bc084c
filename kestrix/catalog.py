"""All registered queries of the engine, with the SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = ("analytics", "documents", "metrics", "vectors", "features", "models", "records", "analyses")


def _families():
    return [import_module(f"kestrix.plans.{name}") for name in FAMILIES]


def queries() -> dict[str, Query]:
    return {name: q for family in _families() for name, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for family in _families() for name, q in family.ORACLE.items()}
