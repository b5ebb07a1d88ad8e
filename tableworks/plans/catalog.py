"""Catalogue of tables: domain index, summaries, upserts and table reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import as_columns, col
from tableworks.operators import ordered, profiling, stats


def domain_index(tables: DataFrame) -> DataFrame:
    """Tables numbered by title within their domain, one row per table.

    ``(domain, position, table_id, title, has_time_series, row_count, column_count)``. Kept as rows:
    a domain may hold a large part of all tables.
    """
    listed = tables.select(
        F.coalesce("domain", F.lit("unknown")).alias("domain"), "table_id",
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("has_time_series", F.lit(False)).alias("has_time_series"),
        F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
        F.coalesce("column_count", F.lit(0)).cast("long").alias("column_count"),
    )
    return ordered.positions(listed, ["title", "table_id"], by=["domain"])


def index_statistics(table_ids: DataFrame, tables: DataFrame) -> DataFrame:
    """Total and mean rows and columns; the means count every table, also those without metadata."""
    sums = tables.agg(F.struct(
        F.sum("row_count").alias("rows"), F.sum("column_count").alias("columns")).alias("s"))
    total = table_ids.agg(F.count(F.lit(1)).alias("total_tables")).withColumn("_s", sums.scalar())
    mean = lambda c: F.coalesce(
        F.try_divide(col("_s")[c].cast("double"), col("total_tables")), F.lit(0.0))
    return total.select("total_tables", mean("rows").alias("avg_rows"), mean("columns").alias("avg_columns"))


def distributions(tables: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of each column as ``(dimension, value, count)``; missing is ``unknown``."""
    filled = tables.select(*[
        F.coalesce(col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns])
    return stats.value_counts_long(filled, columns)


def table_summaries(table_ids: DataFrame, tables: DataFrame, sizes: DataFrame) -> DataFrame:
    """Title, shape and bytes of the stored parts per table; tables without metadata are listed."""
    parts = sizes.groupBy("table_id").pivot("part", ["table", "raw", "meta", "quality_report"]).agg(
        F.sum("bytes"))
    named = parts.select("table_id", *[
        F.coalesce(col(p), F.lit(0)).cast("long").alias(f"{p}_bytes")
        for p in ("table", "raw", "meta", "quality_report")])
    return table_ids.join(tables.select("table_id", "title", "row_count", "column_count"),
                          "table_id", "left").join(named, "table_id", "left").select(
        "table_id", F.coalesce("title", F.lit("Unknown")).alias("title"), "row_count", "column_count",
        *[F.coalesce(col(f"{p}_bytes"), F.lit(0)).alias(f"{p}_bytes")
          for p in ("table", "raw", "meta", "quality_report")])


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by table id with the latest ``added_at``; of equally old ones the new entry wins."""
    both = index.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.max_by(F.struct(*as_columns(index.columns)), F.struct("added_at", "_new"))
    return both.groupBy("table_id").agg(latest.alias("e")).select("e.*")


def with_quality(meta: DataFrame, quality: DataFrame) -> DataFrame:
    """Metadata joined with quality reports (tables that have both) and the derived measures."""
    clean = quality.select(
        "table_id", "rows_removed", "columns_removed", "data_completeness",
        F.col("numeric_columns").alias("numeric_columns_count"))
    both = meta.drop("numeric_ratio", "size_class").join(clean, "table_id")
    return both.withColumns({
        "numeric_ratio": profiling.numeric_ratio(col("numeric_columns_count"), col("column_count")),
        "size_class": profiling.size_class(col("row_count")),
    })


REPORT_MEASURES = [
    "row_count", "column_count", "numeric_ratio", "data_completeness", "rows_removed",
    "columns_removed", "numeric_columns_count",
]


def table_report(tables: DataFrame) -> DataFrame:
    """Means and deviations over all tables, time-series share and two correlations, as one row."""
    return tables.agg(
        F.count(F.lit(1)).alias("total_tables"),
        *[F.avg(m).alias(f"mean_{m}") for m in REPORT_MEASURES],
        *[F.stddev_samp(m).alias(f"std_{m}") for m in REPORT_MEASURES],
        F.count_if("has_time_series").alias("time_series_tables"),
        F.avg(col("has_time_series").cast("int")).alias("time_series_share"),
        F.corr("row_count", "data_completeness").alias("corr_rows_completeness"),
        F.corr("column_count", "numeric_ratio").alias("corr_columns_numeric_ratio"),
    )


def percentages(tables: DataFrame, column: str, classes: list[str] | None = None) -> DataFrame:
    """``(class, count, percent)``; with ``classes`` in that order, unused ones as zero."""
    counts = tables.filter(col(column).isNotNull()).groupBy(col(column).alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    total = tables.agg(F.count(F.lit(1))).scalar()
    if classes is not None:
        spark = tables.sparkSession
        listed = spark.createDataFrame(list(enumerate(classes)), "rank int, class string")
        counts = listed.join(counts, "class", "left").na.fill(0, ["count"]).orderBy("rank")
    return counts.select("class", "count",
                         F.coalesce(F.try_divide(col("count") * 100.0, total), F.lit(0.0)).alias("percent"))
