"""Previews of the tables a question refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import col
from tableworks.operators import profiling, sampling
from tableworks.session import pin

# Preview modes and the number of first rows they show.
MODES = {"header_1": 1, "header_5": 5, "full_table": 1000}


def table_previews(
    rows: DataFrame, headers: DataFrame, titles: DataFrame, mode: str = "header_5",
    max_rows: int | None = None,
) -> DataFrame:
    """One row per table: sample rows as JSON, stats line, description and column structure.

    At most the mode's number of rows is gathered per table (1000 for ``full_table`` unless
    ``max_rows`` says otherwise), however large the table is.
    """
    if mode not in MODES:
        raise ValueError(f"unknown preview mode {mode!r}")
    n = max_rows if max_rows is not None and mode == "full_table" else MODES[mode]
    first = sampling.head(rows, ["table_id"], ["pos"], n)
    sample = first.groupBy("table_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda r: r["cells"]).alias("_rows"))
    columns = pin(profiling.column_profile(rows, headers))  # one row per column, used twice
    shapes = profiling.table_profile(columns)
    structure = profiling.with_first_values(columns, rows).groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "col_pos", "column_name", "dtype", "n_nulls", "sample_value"))).alias("_columns"))
    full = shapes.join(titles, "table_id", "left").join(structure, "table_id").join(
        sample, "table_id", "left")
    as_json = F.transform("_rows", lambda cells: F.to_json(F.map_from_arrays("columns", cells)))
    return full.select(
        "table_id", "row_count",
        F.array_join(as_json, "\n").alias("sample_rows"),
        profiling.stats_line(col("row_count"), col("column_count"), col("numeric_count"),
                             col("text_count")).alias("stats"),
        profiling.description_line(col("table_id"), col("title"), col("year_min"), col("year_max"),
                                   col("row_count"), col("column_count")).alias("description"),
        F.array_join(F.transform("_columns", lambda c: F.concat_ws(
            ":", c["column_name"], c["dtype"], c["n_nulls"].cast("string"), c["sample_value"])), "; ",
        ).alias("structure"),
    )


def question_previews(questions: DataFrame, previews: DataFrame) -> DataFrame:
    """One row per question and referenced table, in reference order.

    A table that does not exist shows a marker instead; the other tables are still shown. A
    question without references has one row that says so.
    """
    refs = questions.select(
        "question_id",
        F.posexplode_outer(F.when(F.size("table_refs") > 0, col("table_refs"))).alias("at", "table_id"))
    shown = refs.join(previews, "table_id", "left")
    absent = F.when(col("table_id").isNull(), F.lit("No tables referenced")).otherwise(
        F.concat(F.lit("Table "), col("table_id"), F.lit(": not found")))
    return shown.select(
        "question_id", F.coalesce("at", F.lit(0)).alias("at"), "table_id",
        F.coalesce("sample_rows", F.lit("No data available")).alias("sample_rows"),
        F.coalesce("stats", absent).alias("stats"), "description", "structure",
    )
