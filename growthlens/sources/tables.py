"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table.  Callers select columns right away so the Parquet
    scan's ReadSchema only holds what the plan uses."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
