"""Column profiles and table metadata.

A corpus of many tables is held as ``rows (table_id, pos BIGINT, cells ARRAY<STRING>)`` and ``headers
(table_id, columns ARRAY<STRING>)``: one record per table row, whatever its width. ``pos`` is the
stored order of the rows within their table. Headers may also have ``types ARRAY<STRING>``: ``int``, ``float`` or
``text`` where the type of a column is known (say, from the table that its cells were taken from), else NULL.
All tables are profiled by one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableworks.functions.columns import as_columns, col, numeric_columns
from tableworks.functions.text import is_integer, number_of
from tableworks.session import broadcast_if_few, pin

IDENTIFIERS = ["Entity", "Country", "Region"]
TIME_COLUMNS = ["Year", "Date", "Time"]


def corpus_rows(df: DataFrame, table_id: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of one typed table in the corpus form."""
    return df.select(
        F.lit(table_id).alias("table_id"), col(order).cast("long").alias("pos"),
        F.array(*[col(c).cast("string") for c in columns]).alias("cells"),
    )


def corpus_headers(
    spark: SparkSession, headers: dict[str, list[str]], types: dict[str, list[str | None]] | None = None,
) -> DataFrame:
    if types is None:
        return spark.createDataFrame(list(headers.items()), "table_id string, columns array<string>")
    return spark.createDataFrame(
        [(t, names, types.get(t)) for t, names in headers.items()],
        "table_id string, columns array<string>, types array<string>")


def catalogue(headers: DataFrame) -> DataFrame:
    """``(table_id, col_pos, column_name)``, positions from 0."""
    return headers.select("table_id", F.posexplode("columns").alias("col_pos", "column_name"))


def column_profile(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per column of every table: counts of rows, nulls and numbers, type, range.

    The type follows CSV inference: int64 and bool need every cell, float64 every non-null cell
    (also a column without any value), the rest is object. ``first_pos`` is the first row with a
    value. Cells of a known type are not looked at as text: a number is cast, a text is none.

    All aggregates are numbers of fixed size, so the cells are hashed and combined where they are read; a
    table that holds most rows of the corpus is no bottleneck.
    """
    if "types" in headers.columns:
        # one row per table: a shuffle would gather the rows of a table in one task
        rows = rows.join(broadcast_if_few(headers.select("table_id", "types")), "table_id")
        cells = rows.select("table_id", "pos", "types", F.posexplode("cells").alias("col_pos", "value"))
        known = F.get("types", col("col_pos"))
    else:
        cells = rows.select("table_id", "pos", F.posexplode("cells").alias("col_pos", "value"))
        known = F.lit(None).cast("string")
    value = col("value")
    boolean = known.isNull() & value.isin("True", "False", "TRUE", "FALSE", "true", "false")
    measured = cells.select(
        "table_id", "col_pos", "value", F.when(value.isNotNull(), col("pos")).alias("at"), known.alias("known"),
        F.when(known.isNull(), number_of(value)).alias("number"), boolean.alias("boolean"))
    open_, there = col("known").isNull(), value.isNotNull()
    numeric = F.when(open_, col("number").isNotNull()).otherwise((col("known") != "text") & there)
    integer = F.when(open_, is_integer(value, col("number"))).otherwise((col("known") == "int") & there)
    # only where the range is asked for
    number = F.when(open_, col("number")).when(col("known") != "text", value.try_cast("double"))
    counted = measured.groupBy("table_id", "col_pos").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n_values"),
        F.count_if(numeric).alias("n_numbers"),
        F.count_if(integer).alias("n_integers"),
        F.count_if("boolean").alias("n_booleans"),
        F.min(number).alias("min_number"), F.max(number).alias("max_number"),
        F.min("at").alias("first_pos"),
    )
    kind = (
        F.when(col("n_integers") == col("n_rows"), "int64")
        .when(col("n_numbers") == col("n_values"), "float64")
        .when(col("n_booleans") == col("n_rows"), "bool")
        .otherwise("object")
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return catalogue(headers).join(counted, ["table_id", "col_pos"], "left").select(
        "table_id", "col_pos", "column_name", count(col("n_rows")).alias("n_rows"),
        count(col("n_rows") - col("n_values")).alias("n_nulls"),
        count(col("n_numbers")).alias("n_numbers"),
        F.coalesce(kind, F.lit("object")).alias("dtype"), "min_number", "max_number", "first_pos",
    )


def with_first_values(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Column profile with ``sample_value``: the first non-null value, else ``No data``.

    The first rows are looked up by position. Their list is as long as the corpus has columns; it
    is broadcast when that is few enough (counted), else joined by shuffle.
    """
    columns = pin(columns)
    wanted = columns.filter("first_pos is not null").select(
        "table_id", "col_pos", F.col("first_pos").alias("pos"))
    found = rows.join(broadcast_if_few(wanted), ["table_id", "pos"]).select(
        "table_id", "col_pos", F.get("cells", col("col_pos")).alias("sample_value"))
    return columns.drop("first_pos").join(found, ["table_id", "col_pos"], "left").withColumn(
        "sample_value", F.coalesce("sample_value", F.lit("No data")))


def table_profile(columns: DataFrame) -> DataFrame:
    """One row per table from its column profile: shape, completeness, numeric columns, year span.

    The lists hold a table's own columns, so they are as long as the table is wide.
    """
    marked = columns.withColumn("numeric", col("dtype").isin("int64", "float64"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["column_name"])
    entry = F.struct("col_pos", "column_name")
    year = col("column_name") == "Year"
    return marked.groupBy("table_id").agg(
        F.max("n_rows").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.count_if("numeric").alias("numeric_count"),
        F.count_if(col("dtype") == "object").alias("text_count"),
        listed(entry).alias("columns"),
        listed(F.when(col("numeric"), entry)).alias("numeric_columns"),
        F.coalesce(F.bool_or(year & col("numeric")), F.lit(False)).alias("has_time_series"),
        F.coalesce(1 - F.try_divide(F.sum("n_nulls"), F.sum("n_rows")), F.lit(0.0))
        .alias("completeness"),
        F.min(F.when(year, col("min_number"))).cast("long").alias("year_min"),
        F.max(F.when(year, col("max_number"))).cast("long").alias("year_max"),
    )


def profile(df: DataFrame, order: list[str]) -> DataFrame:
    """Profile of one typed table: a row per column from one aggregate job.

    ``order`` decides which non-null value comes first.
    """
    key = F.struct(*as_columns(order))
    entries = [
        F.struct(
            F.lit(i).alias("col_pos"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(col(f.name).isNull()).alias("n_nulls"),
            F.coalesce(
                F.min_by(col(f.name), F.when(col(f.name).isNotNull(), key)).cast("string"),
                F.lit("No data"),
            ).alias("sample_value"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.array(*entries).alias("_all")).select(F.inline("_all"))


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns and numeric columns of one typed table, and whether it has a numeric Year."""
    numbers = numeric_columns(df)
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumns({
        "column_count": F.lit(len(df.columns)).cast("long"),
        "numeric_count": F.lit(len(numbers)).cast("long"),
        "has_time_series": F.lit("Year" in numbers),
    })


# Metadata of a table from its profile columns


def complexity_level(rows: Column, columns: Column, numeric: Column, time_series: Column) -> Column:
    """Points for more than 200 rows, more than 10 or 20 columns, 75 % numbers, a time series."""
    points = (
        F.when(rows > 200, 1).otherwise(0)
        + F.when(columns > 20, 2).when(columns > 10, 1).otherwise(0)
        + F.when(numeric_ratio(numeric, columns) >= 0.75, 1).otherwise(0)
        + F.when(time_series, 1).otherwise(0)
    )
    return F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")


def numeric_ratio(numeric: Column, columns: Column) -> Column:
    return F.coalesce(F.try_divide(numeric.cast("double"), columns.cast("double")), F.lit(0.0))


def size_class(rows: Column) -> Column:
    return F.when(rows < 100, "small").when(rows <= 500, "medium").otherwise("large")


def reasoning_kinds(columns: Column, numeric: Column, time_series: Column) -> Column:
    """Which kinds of question a table can carry, from its header and numeric column count."""
    named = F.array_contains(columns, "Entity") | F.array_contains(columns, "Country")
    return F.array_compact(F.array(
        F.when(numeric >= 1, "arithmetic_aggregation"),
        F.when((F.size(columns) > 3) & (numeric >= 1), "conditional_reasoning"),
        F.when(named, "entity_comparison"),
        F.when(time_series, "temporal_analysis"),
    ))


def description_line(
    table_id: Column, title: Column, year_min: Column, year_max: Column, rows: Column,
    columns: Column,
) -> Column:
    """``id: title (first–last year)``; without both, the number of rows and columns."""
    span = F.concat(year_min.cast("string"), F.lit("–"), year_max.cast("string"))
    named = F.when(title != "", title)
    text = F.coalesce(F.concat(named, F.lit(" ("), span, F.lit(")")), named, span,
                      F.concat(rows.cast("string"), F.lit(" rows, "), columns.cast("string"),
                               F.lit(" columns")))
    return F.concat(table_id, F.lit(": "), text)


def stats_line(rows: Column, columns: Column, numeric: Column, text: Column) -> Column:
    return F.concat_ws(
        " | ",
        F.concat(F.lit("rows: "), rows.cast("string")),
        F.concat(F.lit("cols: "), columns.cast("string")),
        F.when(numeric > 0, F.concat(F.lit("Numeric columns: "), numeric.cast("string"))),
        F.when(text > 0, F.concat(F.lit("Text columns: "), text.cast("string"))),
    )


def table_metadata(profiles: DataFrame) -> DataFrame:
    """Metadata record per table from :func:`table_profile` plus ``title`` and ``domain`` columns."""
    kinds = reasoning_kinds(col("columns"), col("numeric_count"), col("has_time_series"))
    return profiles.withColumns({
        "complexity_level": complexity_level(
            col("row_count"), col("column_count"), col("numeric_count"), col("has_time_series")),
        "reasoning": kinds,
        "suitable_for_reasoning": F.size(kinds) > 0,
        "numeric_ratio": numeric_ratio(col("numeric_count"), col("column_count")),
        "size_class": size_class(col("row_count")),
    })


