"""Running totals, positions, batches, exact quantiles and streaks without a one-task window.

A plain ``Window.partitionBy(group).orderBy(...)`` sends a whole group to one task, and a window
without ``partitionBy`` the whole table. Here the rows are range-partitioned by (group, order key)
into bounded pieces, each piece is scanned on its own, and one small row per (piece, group) carries
the totals of the earlier pieces forward. A hot group is cut into as many pieces as it needs.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableworks.functions.columns import as_columns, col, same_value
from tableworks.session import pin


def range_pieces(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` in range partitions by (group, order key), with the piece number in ``_piece``.

    The pieces are pinned: range boundaries come from a sample and must not move between the two
    reads that follow. (group, order key) should identify a row; equal keys stay in one piece.
    """
    ranged = df.repartitionByRange(*as_columns(by + order))
    return pin(ranged.withColumn("_piece", F.spark_partition_id()))


def running(
    pieces: DataFrame, by: list[str], order: list[str],
    sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima per group in key order, and whole-group totals.

    ``pieces`` comes from :func:`range_pieces`; the result keeps ``_piece`` so that a second
    scan can follow without another range shuffle.
    """
    sums, maxima, totals = sums or {}, maxima or {}, totals or {}
    rows = pieces
    for name, value in {**sums, **maxima, **totals}.items():
        rows = rows.withColumn(f"_in_{name}", value)
    per_piece = rows.groupBy("_piece", *as_columns(by)).agg(
        *[F.sum(col(f"_in_{n}")).alias(f"_in_{n}") for n in [*sums, *totals]],
        *[F.max(col(f"_in_{n}")).alias(f"_in_{n}") for n in maxima],
    )
    # at most one row per piece here, whatever the group size
    group = W.partitionBy(*as_columns(by)) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    header = per_piece.select(
        "_piece", *as_columns(by),
        *[F.sum(col(f"_in_{n}")).over(earlier).alias(f"_in_{n}") for n in sums],
        *[F.max(col(f"_in_{n}")).over(earlier).alias(f"_in_{n}") for n in maxima],
        *[F.sum(col(f"_in_{n}")).over(group).alias(f"_in_{n}") for n in totals],
        F.lit(0).alias("_row"),
    )
    both = rows.withColumn("_row", F.lit(1)).unionByName(header, allowMissingColumns=True)
    scan = W.partitionBy("_piece", *as_columns(by)).orderBy("_row", *as_columns(order))
    scan = scan.rowsBetween(W.unboundedPreceding, W.currentRow)
    for n in sums:
        both = both.withColumn(n, F.sum(col(f"_in_{n}")).over(scan))
    for n in maxima:
        both = both.withColumn(n, F.max(col(f"_in_{n}")).over(scan))
    for n in totals:
        both = both.withColumn(n, F.max(F.when(col("_row") == 0, col(f"_in_{n}"))).over(scan))
    made = [*sums, *maxima, *totals]
    kept = [c for c in pieces.columns if c not in made]
    return both.filter("_row = 1").select(*as_columns(kept + made))


def positions(
    df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "position",
) -> DataFrame:
    """Gap-free numbering from 1 in key order, per group when ``by`` is given."""
    by = by or []
    return running(range_pieces(df, by, order), by, order, sums={out: F.lit(1)}).drop("_piece")


def batches(
    df: DataFrame, order: list[str], size: int, by: list[str] | None = None,
) -> DataFrame:
    """Fixed-size batches in key order: ``batch`` and ``batch_position``, both from 1."""
    numbered = positions(df, order, by, out="position")
    return numbered.withColumn(
        "batch", F.floor((col("position") - 1) / F.lit(size)).cast("long") + 1
    ).withColumn("batch_position", (col("position") - 1) % F.lit(size) + 1)


#: Accuracy of the sketches that bracket a quantile; groups of at most so many values are bracketed by all of them.
SKETCH = 10_000


def _beside(rows: DataFrame, facts: DataFrame, by: list[str], few: bool = False) -> DataFrame:
    """``rows`` with the struct ``_f`` of their group; one row of facts per group.

    Every group has facts, so the left join is an inner one that can broadcast the facts alone: by the size
    of their files many rows may look small. With ``few`` groups they are, and the rows stay where they are.
    """
    if not by:
        return rows.withColumn("_f", facts.select(F.struct(*facts.columns)).scalar())
    held = [c for c in facts.columns if c not in by]
    small = facts.select(*[col(k).alias(f"_g{i}") for i, k in enumerate(by)], F.struct(*as_columns(held)).alias("_f"))
    same = same_value([(col(k), col(f"_g{i}")) for i, k in enumerate(by)])
    return rows.join(F.broadcast(small) if few else small, same, "left").drop(*[f"_g{i}" for i in range(len(by))])


def quantiles(
    df: DataFrame, by: list[str], value: str, at: dict[str, float], exact: bool = True,
    accuracy: int = SKETCH, also: list[Column] | None = None, few_groups: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles per group, ``{output name: probability}``; nulls are skipped.

    Exact form, by selection in two passes: a sketch of bounded size brackets each quantile; then values
    inside brackets are counted one by one and all others by the brackets that they lie below. Nothing
    is sorted or written but these few, and no job runs when the result is built. A bracket that turned out
    not to hold its quantile would raise. ``exact=False`` uses the sketch alone. ``also`` are further
    aggregates over all rows of a group, made by the first pass. ``few_groups`` says that there are no more
    groups than can be broadcast (four numbers per group and quantile).
    """
    groups = lambda d: d.groupBy(*as_columns(by))
    valued = df.withColumn("_value", col(value).cast("double"))
    also = also or []
    if not exact:
        outputs = [
            F.percentile_approx(col("_value"), p, accuracy).alias(name) for name, p in at.items()
        ]
        return groups(valued).agg(*outputs, *also)
    margin = 4 / accuracy
    ends = [x for p in at.values() for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    places = range(len(at))
    sketch = groups(valued).agg(
        F.count("_value").alias("_n"), F.min("_value").alias("_least"), F.max("_value").alias("_most"),
        F.percentile_approx("_value", ends, accuracy).alias("_ends"), *also)
    few = col("_n") <= accuracy
    brackets = sketch.select(*as_columns(by), col("_n").alias("n"), *(x for i in places for x in (
        F.when(few, col("_least")).otherwise(col("_ends")[2 * i]).alias(f"lo{i}"),
        F.when(few, col("_most")).otherwise(col("_ends")[2 * i + 1]).alias(f"hi{i}"))))
    f = lambda name: col("_f")[name]
    beside = _beside(valued.select(*as_columns(by), "_value").filter(col("_value").isNotNull()), brackets, by, few_groups)
    inside = functools.reduce(operator.or_, [col("_value").between(f(f"lo{i}"), f(f"hi{i}")) for i in places])
    under = functools.reduce(operator.add, [F.when(col("_value") < f(f"lo{i}"), 1 << i).otherwise(0) for i in places])
    counted = beside.groupBy(
        *as_columns(by), F.when(inside, col("_value")).alias("_value"), F.when(~inside, under).alias("under"),
    ).agg(F.count("*").alias("m"), F.max(f("n")).alias("n"), *(
        F.max(f(f"{end}{i}")).alias(f"{end}{i}") for i in places for end in ("lo", "hi")))
    group = W.partitionBy(*as_columns(by)) if by else W.partitionBy(F.lit(0))
    upto = group.orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    outputs = []
    for i, (name, p) in enumerate(at.items()):
        rank = (col("n") - 1) * F.lit(float(p))
        held = col("_value").between(col(f"lo{i}"), col(f"hi{i}"))
        below = F.coalesce(col("_value") < col(f"lo{i}"), col("under").bitwiseAND(1 << i) > 0)
        counted = counted.withColumn(f"upto{i}", F.sum(F.when(below, col("m")).otherwise(0)).over(group) + F.sum(
            F.when(held, col("m")).otherwise(0)).over(upto))
        low, high = (
            F.max(F.when(held & (r >= col(f"upto{i}") - col("m")) & (r < col(f"upto{i}")), col("_value")))
            for r in (F.floor(rank), F.ceil(rank))
        )
        between = low + (high - low) * F.max(rank - F.floor(rank))
        outputs.append(F.when(between.isNull(), F.raise_error(F.lit(
            f"{value}: the sketch missed a quantile, ask for a higher accuracy"))).otherwise(between).alias(name))
    found = groups(counted).agg(*outputs)
    if not also:
        return found
    held = [c for c in sketch.columns if c not in ("_n", "_least", "_most", "_ends")]
    left = sketch.select(*as_columns(held))
    if not by:
        return left.crossJoin(found)  # one row each
    renamed = found.select(*[col(c).alias(f"_q_{c}" if c in by else c) for c in found.columns])
    return left.join(renamed, same_value([(col(k), col(f"_q_{k}")) for k in by]), "left").drop(*[f"_q_{k}" for k in by])


def streaks(
    df: DataFrame, by: list[str], order: list[str], weight: Column, out: str = "streak",
) -> DataFrame:
    """Sum of a non-negative weight since its last zero, in key order (0 at a zero).

    With a 0/1 weight this is the length of the run of ones that ends at each row.
    """
    weighted = df.withColumn("_weight", F.coalesce(weight, F.lit(0)).cast("long"))
    summed = running(
        range_pieces(weighted, by, order), by, order, sums={"_upto": col("_weight")}
    )
    # the sum at the last zero; it never falls, so a running maximum finds it
    at_zero = F.when(col("_weight") == 0, col("_upto"))
    scanned = running(summed, by, order, maxima={"_base": at_zero})
    return scanned.withColumn(
        out, col("_upto") - F.coalesce(col("_base"), F.lit(0))
    ).drop("_piece", "_weight", "_upto", "_base")
