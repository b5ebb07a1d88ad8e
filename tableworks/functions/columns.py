"""Column checks and type groups shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
SMALL_INTEGRALS = (T.ByteType, T.ShortType, T.IntegerType)


def col(name: str) -> Column:
    """Column by its literal name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    """Raise if a column is missing; names are matched exactly."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s) {missing}; the table has {df.columns}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def as_columns(items: Iterable[str | Column]) -> list[Column]:
    return [col(i) if isinstance(i, str) else i for i in items]


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """Missing numbers are NULL everywhere in this package; NaN is turned into NULL on entry."""
    floats = {
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (not names or f.name in names)
    }
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns
    ])


def same_value(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Null-safe equality over several pairs; stays an equi-join condition for Spark."""
    condition = None
    for a, b in pairs:
        condition = a.eqNullSafe(b) if condition is None else condition & a.eqNullSafe(b)
    return condition
