"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlake.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; the scan stays lazy, so filters and columns are pushed down."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
