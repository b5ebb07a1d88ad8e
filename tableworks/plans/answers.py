"""Answers taken from result rows, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import as_columns, col, is_numeric, is_string, require
from tableworks.operators import ordered, stats


def single_cell_answers(results: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The answer of each question whose result is one row with one column, as text.

    ``results`` holds the result rows of all questions side by side in ``columns``; with more than
    one column or row there is no single answer and the answer is NULL.
    """
    counted = results.groupBy(*as_columns(key)).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(col(columns[0]).cast("string")).alias("_cell"))
    single = (col("_n") == 1) & F.lit(len(columns) == 1)
    return counted.select(*as_columns(key), F.when(single, col("_cell")).alias("answer"))


def result_values(results: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Distinct truthy cells of each question's result, one row per value.

    Empty texts, zeros and false are not truthy.
    """
    require(results, *key, *columns)
    empty = lambda c: "" if is_string(results, c) else 0 if is_numeric(results, c) else False
    cells = F.array(*[F.when(col(c) != F.lit(empty(c)), col(c).cast("string")) for c in columns])
    return results.select(*as_columns(key), F.explode(F.array_compact(cells)).alias("value")).distinct()


#: Values of a chunk of a list answer.
CHUNK = 1000


def answer_chunks(values: DataFrame, key: list[str], size: int = CHUNK) -> DataFrame:
    """List answers of any length as rows: ``(key…, chunk, n_values, answer, digest)``, chunks from 0 in order.

    The text of a list is that of its chunks joined by ", ". A chunk holds at most ``size`` values.
    """
    chunks = ordered.batches(values, ["value"], size, by=key).withColumn("chunk", col("batch") - 1)
    text = F.expr("listagg(value, ', ') within group (order by batch_position)")
    return chunks.groupBy(*as_columns(key), "chunk").agg(
        F.count(F.lit(1)).alias("n_values"), text.alias("answer"), _digest().alias("digest"))


def _digest() -> Column:
    """Digest of a set of values: two sums of independent hashes, so digests of parts add up to that of all."""
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    return F.struct(wide(F.xxhash64("value")).alias("h1"), wide(F.xxhash64(F.lit("second"), "value")).alias("h2"))


def list_digests(parts: DataFrame, key: list[str]) -> DataFrame:
    """``(key…, n_values, digest)`` of whole lists from their chunks; equal lists have equal digests."""
    return parts.groupBy(*as_columns(key)).agg(F.sum("n_values").alias("n_values"), F.struct(
        *[F.sum(col("digest")[h]).alias(h) for h in ("h1", "h2")]).alias("digest"))


def list_answers(values: DataFrame, key: list[str], max_values: int | None = None) -> DataFrame:
    """Values of each question joined in order by ", ", with their number.

    The answer is one text, so a row is as long as its list. Where lists may be too long for a row,
    ``max_values`` leaves the text of longer ones NULL: their whole text is in :func:`answer_chunks`, and
    :func:`same_lists` and :func:`same_long_lists` compare lists of any length.
    """
    numbers = values.groupBy(*as_columns(key)).agg(F.count(F.lit(1)).alias("n_values"))
    fits = F.lit(True) if max_values is None else col("n_values") <= max_values
    short = numbers.filter(fits).select(*as_columns(key))
    texts = stats.attach(short, values, key).groupBy(*as_columns(key)).agg(
        F.expr("listagg(value, ', ') within group (order by value)").alias("answer"))
    return stats.attach(numbers, texts, key)


def same_long_lists(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Whether two list answers are equal, from the digests of their chunks: one small row per question meets."""
    sides = [list_digests(x, key).select(*as_columns(key), F.lit(side).alias("_side"), "n_values", "digest")
             for side, x in enumerate((left, right))]
    both = sides[0].unionByName(sides[1]).groupBy(*as_columns(key))
    of = lambda side, c: F.max(F.when(col("_side") == side, c))
    return both.agg(
        F.coalesce((of(0, col("n_values")) == of(1, col("n_values"))) & (of(0, col("digest")["h1"]) == of(1, col("digest")["h1"]))
                   & (of(0, col("digest")["h2"]) == of(1, col("digest")["h2"])), F.lit(False)).alias("same"),
        F.coalesce(of(0, col("n_values")), F.lit(0)).alias("n_left"), F.coalesce(of(1, col("n_values")), F.lit(0)).alias("n_right"))


def same_lists(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Whether two sets of values per question are equal, compared value by value as a join."""
    both = left.select(*as_columns(key), "value", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*as_columns(key), "value", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    per_value = both.groupBy(*as_columns(key), "value").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return per_value.groupBy(*as_columns(key)).agg(
        (F.min(F.least("_l", "_r")) == 1).alias("same"),
        F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
