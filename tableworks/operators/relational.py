"""Relational operators with explicit null rules.

Every function takes DataFrames and returns a lazy DataFrame. Column names are exact.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableworks.functions.columns import (
    SMALL_INTEGRALS, as_columns, col, is_numeric, is_string, require,
)

Condition = tuple[str, str, object]

_ORDERING = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def save(df: DataFrame, alias: str) -> DataFrame:
    """Name a table for the rest of the session."""
    df.createOrReplaceTempView(alias)
    return df


def use(spark: SparkSession, alias: str) -> DataFrame:
    """Recall a named table; an unknown name raises ``AnalysisException``."""
    return spark.table(alias)


def select(df: DataFrame, *columns: str) -> DataFrame:
    require(df, *columns)
    return df.select(*as_columns(columns))


def condition(df: DataFrame, column: str, op: str, value: object) -> Column:
    """Predicate ``column op value``.

    A null cell matches nothing except ``!=`` (the other comparisons are null there, which a filter
    drops; written this way they reach the Parquet reader). A number never equals a text; ordering
    a number against a text raises here instead of being cast.
    """
    require(df, column)
    c, literal = col(column), F.lit(value)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    mismatch = (is_numeric(df, column) and isinstance(value, str)) or (
        is_string(df, column) and number
    )
    if op == "==":
        return F.lit(False) if mismatch else c == literal
    if op == "!=":
        return F.lit(True) if mismatch else ~c.eqNullSafe(literal)
    if op not in _ORDERING:
        raise ValueError(f"unknown operator {op!r}")
    if mismatch:
        raise TypeError(f"cannot order column {column!r} against {value!r}")
    return _ORDERING[op](c, literal)


def filter_rows(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    return df.filter(condition(df, column, op, value))


def filter_all(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """Rows that meet every condition; no condition keeps all rows."""
    for c in conditions:
        df = df.filter(condition(df, *c))
    return df


def filter_any(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """Rows that meet at least one condition; no condition keeps all rows."""
    if not conditions:
        return df
    if len({(c, op) for c, op, _ in conditions}) == 1 and conditions[0][1] == "==":
        column = conditions[0][0]
        values = [v for _, _, v in conditions]
        # one IN list reaches the Parquet reader; texts against numbers never match
        require(df, column)
        if len({isinstance(v, str) for v in values}) == 1 and not (
            (is_numeric(df, column) and isinstance(values[0], str))
            or (is_string(df, column) and not isinstance(values[0], str))
        ):
            return df.filter(col(column).isin(values))
    return df.filter(functools.reduce(operator.or_, [condition(df, *c) for c in conditions]))


def _operand(df: DataFrame, side: str | int | float) -> tuple[Column, bool]:
    """The operand as a column, and whether it is text."""
    if isinstance(side, str):
        require(df, side)
        if is_string(df, side):
            return col(side), True
        if not is_numeric(df, side):
            raise TypeError(f"column {side!r} is neither a number nor text")
        kind = df.schema[side].dataType
        return (col(side).cast("long") if isinstance(kind, SMALL_INTEGRALS) else col(side)), False
    return F.lit(side), False


def derive(
    df: DataFrame, new: str, left: str | int | float, op: str, right: str | int | float,
    on_zero: str = "null",
) -> DataFrame:
    """New column from one binary operation; an existing name is overwritten.

    Text operands are column names, numbers are literals. ``+`` joins two text columns. A division
    by zero gives NULL, or inf/-inf/NaN with ``on_zero="ieee"``.
    """
    (a, a_text), (b, b_text) = _operand(df, left), _operand(df, right)
    if a_text or b_text:
        if op != "+" or not (a_text and b_text):
            raise TypeError(f"cannot apply {op!r} to {left!r} and {right!r}")
        return df.withColumn(new, F.concat(a, b))
    if op == "+":
        value = a + b
    elif op == "-":
        value = a - b
    elif op == "*":
        value = a * b
    elif op == "/":
        a, b = a.cast("double"), b.cast("double")
        value = F.try_divide(a, b)
        if on_zero == "ieee":
            limits = (
                F.when(a.isNull(), F.lit(None).cast("double"))
                .when((a == 0) | F.isnan(a), F.lit(float("nan")))
                .when(a > 0, F.lit(float("inf")))
                .otherwise(F.lit(float("-inf")))
            )
            value = F.when(b == 0, limits).otherwise(value)
        elif on_zero != "null":
            raise ValueError("on_zero must be 'null' or 'ieee'")
    else:
        raise ValueError(f"unknown operator {op!r}")
    return df.withColumn(new, value)


def aggregate_of(fn: str, column: str) -> Column:
    """sum (0 when nothing is there), mean/avg, max, min or count of the non-null cells."""
    c = col(column)
    if fn == "sum":
        total = F.sum(c)
        return F.coalesce(total, F.lit(0))
    if fn in ("mean", "avg"):
        return F.avg(c)
    if fn in ("max", "min", "count"):
        return getattr(F, fn)(c)
    raise ValueError(f"unknown aggregate {fn!r}")


def derive_aggregate(df: DataFrame, new: str, fn: str, column: str) -> DataFrame:
    """Whole-table aggregate copied to each row, as a scalar subquery (no join, no window)."""
    require(df, column)
    return df.withColumn(new, df.agg(aggregate_of(fn, column)).scalar())


#: A key with more rows than this on one side of a full outer join is dealt over so many salts.
HOT_ROWS, SALTS = 1_000_000, 64


def join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
    nulls: str = "match", split_outer: bool = True, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join on same-named keys; other shared names become ``_x`` and ``_y``.

    Null keys match each other unless ``nulls="sql"``. AQE can split a hot key in inner, left and
    right joins but not in a full outer join, so there the keys that were counted with more than ``hot_rows``
    rows on one side are dealt over salts (see :func:`_salted_outer`); ``split_outer=False`` counts nothing.
    """
    if not on:
        raise ValueError("a join needs at least one key")
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join type {how!r}")
    require(left, *on)
    require(right, *on)
    shared = set(left.columns) & set(right.columns) - set(on)
    l = left.select(*[col(c).alias(f"{c}_x" if c in shared else c) for c in left.columns])
    r = right.select(*[
        col(c).alias(f"_right_{c}" if c in on else f"{c}_y" if c in shared else c)
        for c in right.columns
    ])
    # a side that cannot be null needs no null-safe test, and plain keys keep bucketing usable
    match = functools.reduce(operator.and_, [
        l[f"`{k}`"].eqNullSafe(r[f"`_right_{k}`"])
        if nulls == "match" and left.schema[k].nullable and right.schema[k].nullable
        else l[f"`{k}`"] == r[f"`_right_{k}`"]
        for k in on
    ])
    rest_left = [c for c in l.columns if c not in on]
    rest_right = [c for c in r.columns if not (c.startswith("_right_") and c[7:] in on)]

    if how == "outer" and split_outer:
        return _salted_outer(l, r, on, rest_left, rest_right, nulls == "match", hot_rows)
    joined = l.join(r, match, "full" if how == "outer" else how)
    if how == "right":
        keys = [col(f"_right_{k}").alias(k) for k in on]
    elif how == "outer":
        keys = [F.coalesce(col(k), col(f"_right_{k}")).alias(k) for k in on]
    else:
        keys = as_columns(on)
    return joined.select(*keys, *as_columns(rest_left + rest_right))


def _salted_outer(
    l: DataFrame, r: DataFrame, on: list[str], rest_left: list[str], rest_right: list[str],
    match_nulls: bool, hot_rows: int,
) -> DataFrame:
    """A full outer join in which both sides are read once and a hot key is spread over many tasks.

    One narrow count over the keys of both sides finds the hot ones: at most (all rows / ``hot_rows``) keys.
    The larger side of a hot key is dealt over salts, the other one has a copy for each salt; a copy that
    meets no row of its salt is no unmatched row, because the count says that the key has partners.
    """
    places = range(len(on))
    tagged = lambda df, names, left: df.select(
        *[col(c).alias(f"_k{i}") for i, c in enumerate(names)], F.lit(left).alias("_nl"), F.lit(1 - left).alias("_nr"))
    right_names = [f"_right_{k}" for k in on]
    keys = [f"_k{i}" for i in places]
    counts = tagged(l, on, 1).union(tagged(r, right_names, 0)).groupBy(*keys).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr"))
    hot = counts.filter(F.greatest("_nl", "_nr") > hot_rows)
    # a null key that matches nothing has no partner: its rows only have to be spread
    alone = F.lit(False) if match_nulls else functools.reduce(operator.or_, [col(k).isNull() for k in keys])

    def dealt(df: DataFrame, names: list[str], mine: str, other: str, side: str) -> DataFrame:
        facts = hot.select(*[col(k).alias(f"_{side}{k}") for k in keys], (
            alone | (col(mine) > col(other)) | ((col(mine) == col(other)) & F.lit(side == "l"))).alias("_deal"),
            (~alone & (col(other) > 0)).alias("_met"))
        same = functools.reduce(operator.and_, [col(c).eqNullSafe(col(f"_{side}{k}")) for c, k in zip(names, keys)])
        salt = F.when(col("_deal").isNull() | ~(col("_deal") | col("_met")), F.array(F.lit(0))).when(
            col("_deal"), F.array(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))).otherwise(
            F.sequence(F.lit(0), F.lit(SALTS - 1)))
        return df.join(facts, same, "left").select(
            *as_columns(df.columns), F.explode(salt).alias(f"_{side}salt"),
            F.coalesce(~col("_deal") & col("_met"), F.lit(False)).alias(f"_{side}copy"))

    left, right = dealt(l, on, "_nl", "_nr", "l"), dealt(r, right_names, "_nr", "_nl", "r")
    test = functools.reduce(operator.and_, [
        col(k).eqNullSafe(col(n)) if match_nulls else col(k) == col(n) for k, n in zip(on, right_names)])
    joined = left.join(right, test & (col("_lsalt") == col("_rsalt")), "full")
    alone_left, alone_right = col("_rsalt").isNull() & col("_lcopy"), col("_lsalt").isNull() & col("_rcopy")
    kept = joined.filter(~F.coalesce(alone_left, F.lit(False)) & ~F.coalesce(alone_right, F.lit(False)))
    keyed = [F.when(col("_lsalt").isNotNull(), col(k)).otherwise(col(n)).alias(k) for k, n in zip(on, right_names)]
    return kept.select(*keyed, *as_columns(rest_left + rest_right))


def semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key exists in ``right``."""
    return left.join(right.select(*as_columns(on)).distinct(), on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key does not exist in ``right``."""
    return left.join(right.select(*as_columns(on)).distinct(), on, "left_anti")


def group_aggregate(
    df: DataFrame, keys: list[str], aggregates: list[tuple[str, str]], ordered: bool = False,
) -> DataFrame:
    """``[(fn, column), …]`` per group, named ``fn_column``; a null key is a group of its own.

    Without keys the result is one row, also for an empty table. All aggregates combine on the
    map side, so a hot group does not travel row by row.
    """
    require(df, *keys, *[c for _, c in aggregates])
    written = aggregates
    if keys:  # grouped results list all aggregates of one input column together
        first_use = {c: i for i, (_, c) in reversed(list(enumerate(aggregates)))}
        written = sorted(aggregates, key=lambda a: first_use[a[1]])
    outputs = [aggregate_of(fn, c).alias(f"{fn}_{c}") for fn, c in written]
    if not keys:
        return df.agg(*outputs)
    result = df.groupBy(*as_columns(keys)).agg(*outputs)
    return order(result, *keys) if ordered else result


def order(df: DataFrame, *columns: str, ascending: bool = True) -> DataFrame:
    """Sort by all columns in one direction; nulls come last in both directions."""
    require(df, *columns)
    return df.orderBy(*[
        col(c).asc_nulls_last() if ascending else col(c).desc_nulls_last() for c in columns
    ])


def limit(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows; directly after ``order`` Spark runs both as one top-k."""
    if n < 0:
        raise ValueError("limit must not be negative")
    return df.limit(n)


