"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """`df` itself, or ValueError naming every missing column, before anything is planned."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
