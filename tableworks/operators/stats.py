"""Counts, descriptions, shares, histograms and box-plot numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import as_columns, col, require, same_value
from tableworks.operators import ordered


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``(column, count)``, nulls left out, most frequent first; ties by value."""
    require(df, column)
    counts = df.filter(col(column).isNotNull()).groupBy(col(column)).agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy(F.desc("count"), col(column))
    return counts if top is None else counts.limit(top)


def value_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns in one pass: ``(dimension, value, count)``."""
    return long_form(df, columns, "dimension", "value").filter(
        col("value").isNotNull()
    ).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))


def long_form(
    df: DataFrame, columns: list[str], name: str, value: str, keep: list[str] | None = None,
    kind: str = "string",
) -> DataFrame:
    """Columns turned into ``(name, value)`` rows next to the kept columns."""
    require(df, *columns)
    return df.select(
        *as_columns(keep or []),
        F.explode(F.array(*[
            F.struct(F.lit(c).alias(name), col(c).cast(kind).alias(value)) for c in columns
        ])).alias("_pair"),
    ).select(*as_columns(keep or []), f"_pair.{name}", f"_pair.{value}")


def distinct_count(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    require(df, column)
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(count(col(column)).alias(f"distinct_{column}"))


def describe(
    df: DataFrame, columns: list[str], by: list[str] | None = None, exact: bool = True,
) -> DataFrame:
    """count, mean, median, sample std, min and max per column (and group), one row each."""
    by = by or []
    long = long_form(df, columns, "column", "value", by, "double")
    keys = [*by, "column"]
    return ordered.quantiles(long, keys, "value", {"median": 0.5}, exact, few_groups=not by, also=[
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    ])


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two grouped results on null-safe keys; the key columns come from the left."""
    renamed = right.select(*[col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    joined = left.join(renamed, same_value([(col(k), col(f"_r_{k}")) for k in keys]), "left")
    return joined.drop(*[f"_r_{k}" for k in keys])


def correlation(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair over rows where both are present, as one row."""
    require(df, *[c for pair in pairs for c in pair])
    return df.agg(*[
        F.corr(col(a).cast("double"), col(b).cast("double")).alias(f"corr_{a}_{b}")
        for a, b in pairs
    ])


def crosstab(df: DataFrame, rows: str, columns: str, values: list | None = None) -> DataFrame:
    """Counts of two columns against each other, zero where a pair does not occur."""
    require(df, rows, columns)
    present = df.filter(col(rows).isNotNull() & col(columns).isNotNull())
    return present.groupBy(col(rows)).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def rate(flag: Column) -> Column:
    """Share of rows where the flag is true; a null flag counts as not true."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def rate_by(df: DataFrame, keys: list[str], flag: Column, out: str = "success_rate") -> DataFrame:
    result = df.groupBy(*as_columns(keys)) if keys else df
    return result.agg(F.count(F.lit(1)).alias("count"), rate(flag).alias(out))


def share_of_total(counts: DataFrame, count: str = "count", minor_below: float = 0.01) -> DataFrame:
    """Share of the total per row, and whether it is a minor class (share below the limit)."""
    total = counts.agg(F.sum(col(count))).scalar()
    share = counts.withColumn("share", F.try_divide(col(count).cast("double"), total))
    return share.withColumn(
        "share_class",
        F.when(col("share") < F.lit(minor_below), F.lit("minor")).otherwise(F.lit("main")),
    )


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width histogram over min..max; the last bin includes its right edge.

    ``bins=None`` takes half the number of values, at least 10 and at most 30. Empty bins are
    listed with a zero. A column with a single value gets the range value ± 0.5.
    """
    require(df, column)
    values = df.select(col(column).cast("double").alias("_v")).filter(col("_v").isNotNull())
    n = (
        F.lit(bins) if bins is not None
        else F.greatest(F.lit(10), F.least(F.lit(30), F.floor(F.count("_v") / 2).cast("int")))
    )
    spread = F.when(F.min("_v") == F.max("_v"), 0.5).otherwise(0.0)
    bounds = values.agg(F.struct(
        (F.min("_v") - spread).alias("low"), (F.max("_v") + spread).alias("high"),
        F.count("_v").alias("n"), n.cast("int").alias("bins"),
    ).alias("bounds"))
    measured = values.withColumn("_b", bounds.scalar())
    width = (col("_b")["high"] - col("_b")["low"]) / col("_b")["bins"]
    counted = measured.select(
        F.least(
            F.floor((col("_v") - col("_b")["low"]) / width).cast("int"), col("_b")["bins"] - 1
        ).alias("bin"),
    ).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    grid = spark.range(bins if bins is not None else 30).select(col("id").cast("int").alias("bin"))
    grid = grid.withColumn("_b", bounds.scalar()).filter(
        (col("_b")["n"] > 0) & (col("bin") < col("_b")["bins"])
    )
    step = (col("_b")["high"] - col("_b")["low"]) / col("_b")["bins"]
    edges = grid.select(
        "bin", (col("_b")["low"] + step * col("bin")).alias("low"),
        (col("_b")["low"] + step * (col("bin") + 1)).alias("high"),
    )
    return edges.join(counted, "bin", "left").na.fill(0, ["count"])


def boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outlier count per group."""
    require(df, *by, value)
    rows = df.select(*as_columns(by), col(value).cast("double").alias("_v")).filter(col("_v").isNotNull())
    quartiles = ordered.quantiles(rows, by, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (col("q3") - col("q1")) * 1.5
    inside = (col("_v") >= col("q1") - reach) & (col("_v") <= col("q3") + reach)
    return attach(rows, quartiles, by).groupBy(*as_columns(by)).agg(
        F.count("_v").alias("count"), F.max("q1").alias("q1"), F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
