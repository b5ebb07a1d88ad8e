"""Registered queries over the test tables, one module per area.

Each module holds ``QUERIES`` (name → function of session and folder) and ``SQL`` (name → the
same result in DuckDB SQL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableworks.session import configure


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One test table."""
    return configure(spark).read.parquet(f"{folder}/{table}.parquet")
