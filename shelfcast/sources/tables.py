"""Reading tables: from the catalog by contract, or parquet files by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .contracts import CONTRACTS


def catalog_tables(spark: SparkSession, schema: str) -> dict[str, DataFrame]:
    """The contract tables kept in ``schema`` (``database`` or ``catalog.database``)."""
    return {name: spark.table(f"{schema}.{name}") for name in CONTRACTS}


def parquet_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
