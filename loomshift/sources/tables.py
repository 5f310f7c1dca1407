"""Readers of the Parquet tables. Inputs may lie in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views, so that SQL text can name the tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
