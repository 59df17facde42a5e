"""Reading the test tables and inline fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import parts_of, shared_folder, spread  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    """Inline rows; the same literals stand in the SQL that checks the query."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def fixture_sql(columns: str, rows: str) -> str:
    return f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"
