"""Parquet table access.

Every table is read with an explicit column list, so the scan carries only
what the operator uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """Read ``name`` under ``sf_dir``; with ``columns`` only those."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
