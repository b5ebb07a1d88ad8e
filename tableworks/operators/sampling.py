"""Top rows, previews, caps and repeatable samples.

Stored order is always an explicit order key. Per-group limits are written as
``row_number() <= n``: Spark then drops surplus rows in each task before the shuffle
(``WindowGroupLimit``), so a hot group sends at most n rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableworks.functions.columns import as_columns, col, require


def cap_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in stored order."""
    return df.orderBy(*as_columns(order)).limit(n)


def _first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    window = W.partitionBy(*as_columns(by)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(col("_rank") <= n).drop("_rank")


def head(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return _first_n(df, by, as_columns(order), n)


def head_and_tail(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """n//2 first and the remaining last rows of each group (n = 1: the first row).

    The order key must identify a row within its group; a group of up to ``n`` rows comes back
    whole, each row once.
    """
    if n == 1:
        return head(df, by, order, 1)
    first = _first_n(df, by, as_columns(order), n // 2)
    last = _first_n(df, by, [col(c).desc() for c in order], n - n // 2)
    # at most 2n rows per group are left, so this second look at them is small
    both = first.withColumn("_part", F.lit(0)).unionByName(last.withColumn("_part", F.lit(1)))
    once = W.partitionBy(*as_columns(by), *as_columns(order)).orderBy("_part")
    return both.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1").drop(
        "_copy", "_part"
    )


def top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their counts; ties by value, nulls left out."""
    require(df, column)
    return df.filter(col(column).isNotNull()).groupBy(col(column)).agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy(F.desc("count"), col(column)).limit(n)


def keep_top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent values; rows with a null value go.

    The joined side has at most ``n`` rows, so it is broadcast for n up to 100,000.
    """
    top = top_categories(df, column, n).select(col(column))
    if n <= 100_000:
        top = F.broadcast(top)
    return df.join(top, column, "left_semi")


def seeded_key(columns: list[str], seed: int) -> Column:
    """Pseudo-random sort key of a row: md5 of the seed and the row's identity.

    It depends on the values only, so samples repeat under any partitioning and in any engine.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(c).cast("string") for c in columns]))


def sample(df: DataFrame, identity: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows picked by seed; the whole table when it is smaller."""
    return df.orderBy(seeded_key(identity, seed), *as_columns(identity)).limit(n)


def sample_per_group(
    df: DataFrame, by: list[str], identity: list[str], n: int, seed: int = 42,
) -> DataFrame:
    return _first_n(df, by, [seeded_key(identity, seed), *as_columns(identity)], n)


def shuffle(df: DataFrame, identity: list[str], seed: int) -> DataFrame:
    """The whole table in a repeatable pseudo-random order, with its sort key in ``shuffle_key``."""
    keyed = df.withColumn("shuffle_key", seeded_key(identity, seed))
    return keyed.orderBy("shuffle_key", *as_columns(identity))
