"""All core queries and their SQL, gathered from the query modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["packed_queries", "text_queries", "review_queries", "claim_queries", "image_queries", "tei_queries", "workflow_queries"]


def _modules():
    return [importlib.import_module(f"docsieve.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["longest_shared_run"](spark, sf_dir)
