"""Cleaning of messy tables: one wide table (:func:`clean`) or a whole corpus (:func:`clean_corpus`).

Which columns survive and which texts become numbers depends on the data. One aggregate job finds
that out; everything after it is a lazy projection, filter, join and grouping.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableworks.functions.columns import (
    as_columns, col, is_numeric, is_string, nan_to_null, numeric_columns, require,
)
from tableworks.functions.text import (
    integer_of, is_integer, money_number_of, number_of, squeeze,
)
from tableworks.operators import ordered, sampling
from tableworks.operators.profiling import IDENTIFIERS, TIME_COLUMNS
from tableworks.session import broadcast_if_few, pin


@dataclass(frozen=True)
class Policy:
    """Limits and choices of the cleaning steps. ``None`` switches a cap off."""

    numeric: str = "keep_na"  # keep_na | mean | median
    categorical: str = "keep_na"  # keep_na | mode
    min_rows: int = 5
    min_columns: int = 3
    max_missing_ratio: float = 0.9
    numeric_share: float = 0.8
    min_numeric_columns: int = 1
    min_completeness: float = 0.3
    min_entity_share: float = 0.5
    max_rows: int | None = None
    max_entities: int | None = None
    remove_duplicates: bool = True
    standard_names: bool = True

    @property
    def keeps_missing(self) -> bool:
        return self.numeric == "keep_na" and self.categorical == "keep_na"

    @property
    def rows_after_missing(self) -> int:
        return max(1, self.min_rows // 2) if self.numeric == "keep_na" else self.min_rows


@dataclass(frozen=True)
class Cleaned:
    """``table`` is None when an early check rejected the input; ``report`` always has one row."""

    table: DataFrame | None
    report: DataFrame


# Single steps for one wide table


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna("all", subset=columns)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value; one job counts all of them."""
    counts = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*as_columns(c for i, c in enumerate(df.columns) if counts[i]))


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.select(*as_columns(c for c in df.columns if not c.startswith("Unnamed")))


def impute(df: DataFrame, policy: Policy, order: list[str] | None = None) -> DataFrame:
    """Nulls replaced by column mean, median or most frequent value (ties: the smallest).

    Identifier, time and ``order`` columns stay as they are. Fill values come from aggregate jobs that return
    one row per column.
    """
    free = [c for c in df.columns if c not in IDENTIFIERS + TIME_COLUMNS + (order or [])]
    numbers = [c for c in free if is_numeric(df, c)]
    texts = [c for c in free if is_string(df, c)]
    fills = {}
    if policy.numeric == "mean" and numbers:
        row = df.agg(*[F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(numbers)]).first()
        fills.update({c: row[i] for i, c in enumerate(numbers)})
    if policy.numeric == "median" and numbers:
        from tableworks.operators.stats import long_form
        long = long_form(df, numbers, "column", "value", kind="double")
        found = ordered.quantiles(long, ["column"], "value", {"median": 0.5}).collect()
        fills.update({r["column"]: r["median"] for r in found})
    if policy.categorical == "mode" and texts:
        fills.update(modes(df, texts))
    return df.select(*[
        F.coalesce(col(c), F.lit(fills[c])).alias(c) if fills.get(c) is not None else col(c)
        for c in df.columns
    ])


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent non-null text of each column; of equally frequent ones the smallest."""
    from tableworks.operators.stats import long_form
    counts = long_form(df, columns, "column", "value").filter("value is not null").groupBy(
        "column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-col("n"), "value")).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def texts_to_numbers(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Text columns of which more than ``share`` of all rows read as numbers become double."""
    texts = [c for c in df.columns if is_string(df, c) and c not in IDENTIFIERS]
    if not texts:
        return df
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(money_number_of(col(c))) for c in texts]
    ).first()
    chosen = {c for i, c in enumerate(texts) if row["n"] and row[i + 1] / row["n"] > share}
    return df.select(*[
        money_number_of(col(c)).alias(c) if c in chosen else col(c) for c in df.columns
    ])


def standard_names(df: DataFrame) -> DataFrame:
    """Column names trimmed and with single blanks; two equal names are an error."""
    names = [" ".join(c.split()) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash after normalisation: {names}")
    return df.toDF(*names)


def drop_duplicates(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Equal rows once. ``order`` columns are not compared; their first value is kept.

    Written as a grouping, so that copies already collapse before the shuffle.
    """
    order = order or []
    data = [c for c in df.columns if c not in order]
    grouped = df.groupBy(*as_columns(data))
    if not order:
        return grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    if len(order) == 1:  # a single number as buffer keeps the aggregate hashed
        return grouped.agg(F.min(col(order[0])).alias(order[0])).select(*as_columns(df.columns))
    first = F.min(F.struct(*as_columns(order))).alias("_first")
    return grouped.agg(first).select(*[
        col("_first")[c].alias(c) if c in order else col(c) for c in df.columns
    ])


def cap_entities(df: DataFrame, column: str, n: int) -> DataFrame:
    """Above ``n`` distinct values only the rows of the ``n`` most frequent ones stay.

    Ties go to the smaller value. Null entities stay as long as the cap does not act.
    """
    entities = df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("_n"))
    many = (entities.agg(F.count(col(column))).scalar() > n)
    top = sampling.top_categories(df, column, n).select(
        col(column).alias("_top"), F.lit(True).alias("_in"))
    if n <= 100_000:
        top = F.broadcast(top)
    marked = df.join(top, col(column) == col("_top"), "left")
    return marked.filter(~many | col("_in")).drop("_top", "_in")


def clean(df: DataFrame, order: list[str], policy: Policy = Policy(), name: str = "table") -> Cleaned:
    """The full pipeline over one table. ``order`` columns hold the stored order, not data."""
    require(df, *order)
    df = nan_to_null(df)
    data = [c for c in df.columns if c not in order]
    rows = drop_empty_rows(df, data)
    named = [c for c in data if not c.startswith("Unnamed")]
    texts = [c for c in named if is_string(df, c) and c not in IDENTIFIERS]
    filled = policy.categorical == "mode" and not policy.keeps_missing
    mode = modes(rows, texts) if filled and texts else {}
    kept = _kept(policy, named)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"),
        *[F.count(col(c)).alias(f"has{i}") for i, c in enumerate(named)],
        *[F.count_if(kept & money_number_of(_filled(c, mode)).isNotNull()).alias(f"num{i}")
          for i, c in enumerate(texts)],
    ).first()
    columns = [c for i, c in enumerate(named) if facts[f"has{i}"]]
    nulls = sum(facts["n"] - facts[f"has{named.index(c)}"] for c in columns)
    reason = None
    if facts["n"] < policy.min_rows or len(columns) < policy.min_columns:
        reason = "too small"
    elif nulls / (facts["n"] * len(columns)) > policy.max_missing_ratio:
        reason = "too many missing values"
    elif facts["kept"] < policy.rows_after_missing:
        reason = "too few rows after missing values"
    elif policy.standard_names and len({" ".join(c.split()) for c in columns}) < len(columns):
        reason = "column names clash"
    if reason:
        return Cleaned(None, _summary(df, data, None, [], policy, name, reason))

    numeric = [
        c for i, c in enumerate(texts)
        if c in columns and facts[f"num{i}"] / facts["kept"] > policy.numeric_share
    ]
    table = rows.select(*as_columns(columns), *as_columns(order))
    if not policy.keeps_missing:
        table = impute(table, policy, order)
    table = table.filter(kept)
    table = table.select(*[
        money_number_of(col(c)).alias(c) if c in numeric else col(c) for c in table.columns
    ])
    if policy.standard_names:
        table = standard_names(table.select(*as_columns(columns), *as_columns(order)))
        columns = [" ".join(c.split()) for c in columns]
    if policy.remove_duplicates:
        table = drop_duplicates(table, order)
    if policy.max_rows is not None:
        table = sampling.cap_rows(table, order, policy.max_rows)
    if policy.max_entities is not None and "Entity" in columns:
        table = cap_entities(table, "Entity", policy.max_entities)
    return Cleaned(table, _summary(df, data, table, columns, policy, name, None))


def _filled(column: str, mode: dict[str, str]) -> Column:
    return F.coalesce(col(column), F.lit(mode[column])) if column in mode else col(column)


def _kept(policy: Policy, columns: list[str]) -> Column:
    """Rows that stay after the missing-value step, judged by their identifier columns."""
    if policy.keeps_missing:
        present = [col(c).isNotNull() for c in IDENTIFIERS if c in columns]
        return functools.reduce(operator.or_, present, F.lit(False)) if present else F.lit(True)
    present = [col(c).isNotNull() for c in IDENTIFIERS + TIME_COLUMNS if c in columns]
    return functools.reduce(operator.and_, present, F.lit(True))


def _verdict(
    policy: Policy, rows: Column, columns: Column, numeric: Column, numeric_values: Column,
    entity_share: Column, completeness: Column,
) -> Column:
    """Reason for a final rejection, NULL when the table passes."""
    checks = [(rows < policy.min_rows, "too few rows"), (columns < policy.min_columns, "too few columns")]
    if policy.numeric == "keep_na":
        checks.append((F.coalesce(entity_share, F.lit(1.0)) < policy.min_entity_share,
                       "too few entities"))
        checks.append(((numeric > 0) & (numeric_values == 0), "no numeric values"))
    else:
        checks.append((completeness < policy.min_completeness, "too incomplete"))
    checks.append((numeric < policy.min_numeric_columns, "too few numeric columns"))
    reason = None
    for failed, text in checks:
        reason = F.when(failed, text) if reason is None else reason.when(failed, text)
    return reason


def _summary(
    original: DataFrame, data: list[str], table: DataFrame | None, columns: list[str],
    policy: Policy, name: str, reason: str | None,
) -> DataFrame:
    """Shapes, removed rows and columns, completeness and verdict, as one lazy row."""
    before = original.agg(F.count(F.lit(1)).alias("original_rows")).select(
        F.lit(name).alias("table_id"), "original_rows",
        F.lit(len(data)).cast("long").alias("original_columns"),
    )
    zero = F.lit(0).cast("long")
    if table is None:
        return before.select(
            "table_id", F.lit(False).alias("passed"), F.lit(reason).alias("reason"),
            "original_rows", "original_columns", zero.alias("final_rows"),
            zero.alias("final_columns"), col("original_rows").alias("rows_removed"),
            col("original_columns").alias("columns_removed"),
            F.lit(0.0).alias("data_completeness"), zero.alias("numeric_columns"),
        )
    numbers = [c for c in columns if c in numeric_columns(table)]
    present = functools.reduce(operator.add, [F.count(col(c)) for c in columns])
    number_cells = functools.reduce(
        operator.add, [F.count(col(c)) for c in numbers], F.lit(0))
    entity = F.count(col("Entity")) if "Entity" in columns else F.lit(None).cast("long")
    after = table.agg(F.struct(
        F.count(F.lit(1)).alias("rows"), present.alias("present"),
        number_cells.alias("number_cells"), entity.alias("entity"),
    ).alias("f")).scalar()
    full = before.withColumn("f", after)
    rows = col("f")["rows"]
    completeness = F.coalesce(
        F.try_divide(col("f")["present"].cast("double"), rows * len(columns)), F.lit(0.0))
    full = full.withColumns({
        "completeness": completeness,
        "why": _verdict(policy, rows, F.lit(len(columns)), F.lit(len(numbers)),
                        col("f")["number_cells"], F.try_divide(col("f")["entity"], rows),
                        completeness),
    })
    ok = col("why").isNull()
    return full.select(
        "table_id", ok.alias("passed"), col("why").alias("reason"),
        "original_rows", "original_columns",
        F.when(ok, rows).otherwise(zero).alias("final_rows"),
        F.when(ok, F.lit(len(columns)).cast("long")).otherwise(zero).alias("final_columns"),
        F.when(ok, col("original_rows") - rows).otherwise(col("original_rows")).alias("rows_removed"),
        F.when(ok, col("original_columns") - len(columns)).otherwise(col("original_columns"))
        .alias("columns_removed"),
        F.when(ok, col("completeness")).otherwise(0.0).alias("data_completeness"),
        F.when(ok, F.lit(len(numbers)).cast("long")).otherwise(zero).alias("numeric_columns"),
    )


# A whole corpus in the form of tableworks.operators.profiling


@dataclass(frozen=True)
class CleanedCorpus:
    """Cleaned rows and headers of the tables that passed, and one report row per input table."""

    rows: DataFrame
    headers: DataFrame
    report: DataFrame


def corpus_decisions(rows: DataFrame, headers: DataFrame, policy: Policy) -> DataFrame:
    """Per table: early verdict and the surviving columns with their kinds.

    One aggregate over (table, column) for the whole corpus. ``keep`` is an array as long as the
    table is wide, of (position, name, kind, fill, known type) with kind int, float, money (text read as a number)
    or text. Cells of a column that is known to hold numbers are cast, without a look at their form.
    """
    named = IDENTIFIERS if policy.keeps_missing else IDENTIFIERS + TIME_COLUMNS
    ids = F.filter(
        F.transform("columns", lambda c, i: F.when(c.isin(named), i)), lambda i: i.isNotNull()
    )
    # one row per table: a shuffle would gather the rows of a table in one task
    types = "types" if "types" in headers.columns else F.lit(None).cast("array<string>").alias("types")
    faced = rows.join(broadcast_if_few(headers.select("table_id", ids.alias("ids"), types)), "table_id")
    # some identifier is there, or, where missing values are filled, all of them
    judged = F.exists if policy.keeps_missing else F.forall
    stays = (F.size("ids") == 0) | judged(
        "ids", lambda i: F.get(col("cells"), i.cast("int")).isNotNull())
    cells = faced.select(
        "table_id", stays.alias("stays"), F.posexplode("cells").alias("col_pos", "value"), "types",
        F.exists("cells", lambda c: c.isNotNull()).alias("filled"),
    )
    value, live = col("value"), col("filled")
    cells = cells.withColumn("known", F.get("types", col("col_pos"))).drop("types")
    cells = cells.withColumn("number", _number_in(value, col("known")))
    cash = F.when(_is_number(col("known")), col("number")).otherwise(money_number_of(value))
    counted = cells.groupBy("table_id", "col_pos").agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(live).alias("n"), F.count_if(live & col("stays")).alias("kept"),
        F.count(value).alias("present"),
        F.count("number").alias("numbers"),
        F.count_if(is_integer(value, col("number"))).alias("integers"),
        F.count_if(live & col("stays") & cash.isNotNull()).alias("money"),
        F.count_if(live & col("stays") & value.isNull()).alias("gaps"),
        F.avg("number").alias("mean"),
    )
    listed = headers.select("table_id", types, F.posexplode("columns").alias("col_pos", "column_name"))
    named = listed.withColumn("known", F.get("types", col("col_pos"))).drop("types").join(counted, ["table_id", "col_pos"], "left")
    named = _with_fills(named, headers, cells, policy)
    # gaps that are filled with a text that reads as a number count as numbers
    money = col("money") + F.when(money_number_of(col("fill")).isNotNull(), col("gaps")).otherwise(0)
    clean_name = squeeze(col("column_name")) if policy.standard_names else col("column_name")
    kind = (
        F.when((col("integers") == col("present")) & (col("present") == col("n")), "int")
        .when(col("numbers") == col("present"), "float")
        .when(~col("column_name").isin(IDENTIFIERS)
              & (F.try_divide(money.cast("double"), col("kept")) > policy.numeric_share), "money")
        .otherwise("text")
    )
    good = (col("present") > 0) & ~col("column_name").startswith("Unnamed")
    per_table = named.groupBy("table_id").agg(
        F.coalesce(F.max("original_rows"), F.lit(0)).alias("original_rows"),
        F.count(F.lit(1)).alias("original_columns"),
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        F.coalesce(F.max("kept"), F.lit(0)).alias("kept"),
        F.count_if(good).alias("width"),
        F.coalesce(F.sum(F.when(good, col("n") - col("present"))), F.lit(0)).alias("nulls"),
        # as long as the table is wide
        F.array_sort(F.collect_list(F.when(good, F.struct(
            "col_pos", clean_name.alias("name"), kind.alias("kind"), "fill", "known")))).alias("keep"),
    )
    missing = F.try_divide(col("nulls").cast("double"), col("n") * col("width"))
    clash = F.size(F.array_distinct(F.transform("keep", lambda k: k["name"]))) < F.size("keep")
    early = (
        F.when((col("n") < policy.min_rows) | (col("width") < policy.min_columns), "too small")
        .when(missing > policy.max_missing_ratio, "too many missing values")
        .when(col("kept") < policy.rows_after_missing, "too few rows after missing values")
        .when(clash, "column names clash")
    )
    return per_table.withColumn("early", early)


#: A corpus of so many columns at most has its column facts broadcast.
FEW_COLUMNS = 200_000


def few_columns(headers: DataFrame) -> bool:
    """Whether facts per column can be broadcast; one small job over the headers."""
    return (headers.agg(F.sum(F.size("columns"))).first()[0] or 0) <= FEW_COLUMNS


def _with_fills(named: DataFrame, headers: DataFrame, cells: DataFrame, policy: Policy) -> DataFrame:
    """Column facts with ``fill``: what missing cells become, as text; null where they stay missing.

    Mean, median and most frequent text (ties: the smallest) are grouped by (table, column) over the whole
    corpus. Identifier and time columns are not filled.
    """
    if policy.keeps_missing:
        return named.withColumn("fill", F.lit(None).cast("string"))
    keys = ["table_id", "col_pos"]
    free = ~col("column_name").isin(IDENTIFIERS + TIME_COLUMNS)
    numeric = col("numbers") == col("present")
    fill = F.lit(None).cast("string")
    if policy.numeric == "mean":
        fill = F.when(free & numeric, col("mean").cast("string"))
    # one row of facts per column: broadcast, so that a column is not gathered in one task
    few = few_columns(headers)
    if policy.numeric == "median":
        middle = ordered.quantiles(cells, keys, "number", {"median": 0.5}, few_groups=few)
        named = named.join(middle, keys, "left")
        fill = F.when(free & numeric, col("median").cast("string"))
    if policy.categorical == "mode":
        counts = cells.filter("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("times"))
        most = counts.groupBy(*keys).agg(F.max("times").alias("times"))
        common = counts.join(F.broadcast(most) if few else most, [*keys, "times"]).groupBy(*keys).agg(F.min("value").alias("common"))
        named = named.join(common, keys, "left")
        fill = F.when(free & ~numeric, col("common")).otherwise(fill)
    return named.withColumn("fill", fill)


def _is_number(known: Column) -> Column:
    return F.coalesce(known.isin("int", "float"), F.lit(False))


def _number_in(cell: Column, known: Column) -> Column:
    """The number of a cell; of a column of numbers every cell is one, but for NaN."""
    return F.when(_is_number(known), F.when(cell != "NaN", cell.try_cast("double"))).otherwise(number_of(cell))


def _clean_cell(cell: Column, kind: Column, known: Column) -> Column:
    """A cell in the text form of its kind, so that equal numbers are equal texts."""
    return (
        F.when((kind == "int") & _is_number(known), cell.try_cast("long").cast("string"))
        .when(kind == "int", integer_of(cell).cast("string"))
        .when(kind == "float", _number_in(cell, known).cast("string"))
        .when(kind == "money", money_number_of(cell).cast("string"))
        .otherwise(cell)
    )


def clean_corpus(rows: DataFrame, headers: DataFrame, policy: Policy = Policy()) -> CleanedCorpus:
    """The full pipeline over all tables of a corpus at once, with the steps and verdicts of :func:`clean`.

    Without caps the report is made from digests of the rows, and the rows are cleaned again where they are asked for.
    """
    headers = pin(headers)
    decisions = pin(corpus_decisions(rows, headers, policy))  # one row per table, used three times
    going = broadcast_if_few(
        decisions.filter(col("early").isNull()).select("table_id", "keep"), 20_000)
    named = IDENTIFIERS if policy.keeps_missing else IDENTIFIERS + TIME_COLUMNS
    id_at = F.filter("keep", lambda k: k["name"].isin(named))
    lively = rows.filter(F.exists("cells", lambda c: c.isNotNull())).join(going, "table_id")
    judged = F.exists if policy.keeps_missing else F.forall
    stays = (F.size(id_at) == 0) | judged(
        id_at, lambda k: F.get(col("cells"), k["col_pos"]).isNotNull())
    table = lively.filter(stays).select(
        "table_id", "pos",
        F.transform("keep", lambda k: _clean_cell(
            F.coalesce(F.get(col("cells"), k["col_pos"]), k["fill"]), k["kind"], k["known"]))
        .alias("cells"),
    )
    capped = policy.max_rows is not None or policy.max_entities is not None
    cleaned = table
    if policy.remove_duplicates:
        table = table.groupBy("table_id", "cells").agg(F.min("pos").alias("pos"))
    if policy.max_rows is not None:
        table = sampling.head(table, ["table_id"], ["pos"], policy.max_rows)
    if capped:
        # rows, headers and report all need the rows that are left; find them once
        table = pin(table)
        if policy.max_entities is not None:
            table = _cap_corpus_entities(table, going, policy.max_entities)
        cleaned = table
    counted = _filled_cells(cleaned, policy.remove_duplicates and not capped)
    columns = going.select("table_id", F.posexplode("keep").alias("at", "k")).select(
        "table_id", "at", "k.name", "k.kind")
    number = col("kind") != "text"
    final = columns.join(counted, ["table_id", "at"], "left").groupBy("table_id").agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("final_rows"),
        F.count(F.lit(1)).alias("final_columns"),
        F.coalesce(F.sum("present"), F.lit(0)).alias("present"),
        F.count_if(number).alias("numbers"),
        F.coalesce(F.sum(F.when(number, col("present"))), F.lit(0)).alias("number_cells"),
        F.max(F.when(col("name") == "Entity", col("present"))).alias("entity"),
    )
    completeness = F.coalesce(F.try_divide(
        col("present").cast("double"), col("final_rows") * col("final_columns")), F.lit(0.0))
    late = _verdict(policy, col("final_rows"), col("final_columns"), col("numbers"),
                    col("number_cells"), F.try_divide(col("entity"), col("final_rows")), completeness)
    judged = decisions.join(final, "table_id", "left").withColumns({
        "completeness": completeness, "reason": F.coalesce("early", late),
    })
    ok = col("reason").isNull()
    zero = F.lit(0).cast("long")
    report = judged.select(
        "table_id", ok.alias("passed"), "reason", "original_rows", "original_columns",
        F.when(ok, col("final_rows")).otherwise(zero).alias("final_rows"),
        F.when(ok, col("final_columns")).otherwise(zero).alias("final_columns"),
        (col("original_rows") - F.when(ok, col("final_rows")).otherwise(zero)).alias("rows_removed"),
        (col("original_columns") - F.when(ok, col("final_columns")).otherwise(zero))
        .alias("columns_removed"),
        F.when(ok, col("completeness")).otherwise(0.0).alias("data_completeness"),
        F.when(ok, col("numbers")).otherwise(zero).alias("numeric_columns"),
    )
    passed = report.filter("passed").select("table_id")
    if few_columns(headers):  # and fewer tables
        passed = F.broadcast(passed)
    return CleanedCorpus(
        table.join(passed, "table_id", "left_semi"),
        going.join(passed, "table_id", "left_semi").select(
            "table_id", F.transform("keep", lambda k: k["name"]).alias("columns")),
        report,
    )


def _filled_cells(table: DataFrame, distinct: bool) -> DataFrame:
    """``(table_id, at, n, present)``: rows and filled cells per column, pinned. With ``distinct`` equal rows count once;
    of a row only two digests and which cells are there travel for that, however long its texts are."""
    there = F.transform("cells", lambda c: c.isNotNull()).alias("there")
    if distinct:
        # a digest passes over missing cells, so the key holds where they are
        table = table.select("table_id", there, F.xxhash64("cells").alias("h1"), F.xxhash64(F.lit("b"), "cells").alias("h2")).distinct()
    else:
        table = table.select("table_id", there)
    shapes = table.groupBy("table_id", "there").agg(F.count(F.lit(1)).alias("m"))
    return pin(shapes.select("table_id", "m", F.posexplode("there").alias("at", "is")).groupBy("table_id", "at").agg(
        F.sum("m").alias("n"), F.sum(F.when(col("is"), col("m")).otherwise(0)).alias("present")))


def _cap_corpus_entities(table: DataFrame, going: DataFrame, n: int) -> DataFrame:
    """Per table: above ``n`` distinct entities only the rows of the ``n`` most frequent ones."""
    at = F.array_position(F.transform("keep", lambda k: k["name"]), "Entity")
    with_entity = table.join(going.select("table_id", at.cast("int").alias("_at")), "table_id")
    with_entity = with_entity.withColumn(
        "_entity", F.when(col("_at") > 0, F.get("cells", col("_at") - 1)))
    counts = with_entity.filter("_entity is not null").groupBy("table_id", "_entity").agg(
        F.count(F.lit(1)).alias("_n"))
    crowded = counts.groupBy("table_id").agg((F.count(F.lit(1)) > n).alias("_crowded")).filter("_crowded")
    rank = W.partitionBy("table_id").orderBy(F.desc("_n"), "_entity")
    top = counts.withColumn("_rank", F.row_number().over(rank)).filter(col("_rank") <= n).select(
        "table_id", "_entity", F.lit(True).alias("_in"))
    marked = with_entity.join(crowded, "table_id", "left").join(top, ["table_id", "_entity"], "left")
    return marked.filter(col("_crowded").isNull() | col("_in")).select("table_id", "pos", "cells")
