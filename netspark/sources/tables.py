"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns that a plan does not use are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
