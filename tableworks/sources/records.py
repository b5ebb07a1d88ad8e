"""CSV records out of splittable text files: line breaks, commas and quotes inside quoted cells.

A line maps the state in front of it (outside or inside a quoted cell) to the state behind it, and so does every
block of a file. Lines are mapped where they are read; a scan over one small row per block settles the state
in front of each block, a scan inside the block that of each line. A line that starts and ends outside is a
record; only lines of longer records meet in a grouping, across blocks if they have to.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: States while a line is read: in a plain cell, inside quotes, behind a closing quote, at the start of a record.
_PLAIN, _INSIDE, _CLOSED, _START = range(4)


def _turned(state: Column, segment: Column) -> Column:
    """The state behind a quote, from the state and the text in front of it.

    A quote opens a cell only at its start; elsewhere in a plain cell it is an ordinary character, and
    right behind a closing quote it stands for itself.
    """
    fresh = F.endswith(segment, F.lit(",")) | ((segment == "") & state.isin(_CLOSED, _START))
    return F.when(state == _INSIDE, _CLOSED).when(fresh, _INSIDE).otherwise(_PLAIN)


def _mapped(value: Column) -> Column:
    """``struct(from_out, from_in)``: the state behind a line (1 inside) for both states in front of it."""
    segments = F.split(value, '"', -1)
    folded = F.aggregate(
        F.slice(segments, 1, F.size(segments) - 1), F.struct(F.lit(_START).alias("a"), F.lit(_INSIDE).alias("b")),
        lambda s, x: F.struct(_turned(s["a"], x).alias("a"), _turned(s["b"], x).alias("b")),
        lambda s: F.struct((s["a"] == _INSIDE).cast("int").alias("from_out"), (s["b"] == _INSIDE).cast("int").alias("from_in")))
    return F.when(F.contains(value, F.lit('"')), folded).otherwise(
        F.struct(F.lit(0).alias("from_out"), F.lit(1).alias("from_in")))


def _in_front(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` with ``fixed`` and ``turns``: the state in front of a row is ``fixed`` (or, where that is null,
    the state in front of the first row) turned over if ``turns`` is 1.

    A map either fixes the state, turns it over or keeps it, so a running count of turns and the last fixed
    state compose all maps before a row.
    """
    upto = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    turn = (F.col("from_out") > F.col("from_in")).cast("int")
    counted = rows.withColumn("_turns", F.sum(turn).over(upto) % 2)
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out").bitwiseXOR(F.col("_turns").cast("int")))
    return counted.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before)).withColumn(
        "turns", F.col("_turns").cast("int").bitwiseXOR(turn)).drop("_turns")


def _state(first: Column) -> Column:
    """The state in front of a row of :func:`_in_front` with ``first`` in front of all rows."""
    return F.coalesce("fixed", first).bitwiseXOR(F.col("turns"))


def _behind(state: Column) -> Column:
    return F.when(state == 1, F.col("from_in")).otherwise(F.col("from_out"))


def _text_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lines with the file, the offset of the block they were read in, and a number that grows within a file."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("lineSep", "\n")
    return read.text(root).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"))


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: ``state`` in front of it, ``owner``, the block of the record that is open there, and of
    its file whether it ends inside a quoted cell (``unclosed``) and where that begins (``last_owner``)."""
    each = _in_front(lines.select("path", "block", "pos", "from_out", "from_in"), ["path", "block"], "pos")
    both = each.select("path", "block", "pos", *(
        c.alias(f"{n}{s}") for s in (0, 1) for n, c in (("state", _state(F.lit(s))), ("end", _behind(_state(F.lit(s)))))))
    blocks = both.groupBy("path", "block").agg(*(
        x for s, n in ((0, "out"), (1, "in")) for x in (
            # the state behind the last line, and whether a record starts in the block
            (F.max(F.col("pos") * 2 + F.col(f"end{s}")) % 2).cast("int").alias(f"from_{n}"),
            F.max(F.col(f"state{s}") == 0).alias(f"starts_{n}"))))
    placed = _in_front(blocks, ["path"], "block").withColumn("state", _state(F.lit(0)))
    starts = F.when(F.col("state") == 1, F.col("starts_in")).otherwise(F.col("starts_out"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    file = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = F.when(starts, F.col("block"))
    return placed.select(
        "path", "block", "state", F.last(own, ignorenulls=True).over(before).alias("owner"),
        (F.last(_behind(F.col("state"))).over(file) == 1).alias("unclosed"), F.last(own, ignorenulls=True).over(file).alias("last_owner"))


def csv_records(spark: SparkSession, root: str, name: str = "*.csv") -> DataFrame:
    """``(path, block, pos, record)``: every record of the CSV files below ``root``, ordered by ``pos`` in a file.

    Line breaks inside quoted cells stay in the record. Blank lines between records are left out. Where a file
    ends inside a quoted cell, each line from the start of that record on is a record of its own, so one
    stray quote gathers nothing. Carriage returns before the line feed that ends a record are dropped.
    """
    lines = _text_lines(spark, root, name).select("*", _mapped(F.col("value")).alias("_m")).select(
        "value", "path", "block", "pos", "_m.from_out", "_m.from_in")
    each = _in_front(lines, ["path", "block"], "pos").join(_blocks(lines), ["path", "block"])
    each = each.withColumn("state", _state(F.col("state")))
    within = W.partitionBy("path", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.when(F.col("state") == 0, F.col("pos"))
    each = each.withColumn("begun", F.last(start, ignorenulls=True).over(within)).withColumn(
        "last_begun", F.max(start).over(W.partitionBy("path", "block")))
    # the last record of a block may go on in the next ones, so it is named by the block alone
    each = each.withColumn("record_block", F.when(F.col("begun").isNull(), F.col("owner")).otherwise(F.col("block"))).withColumn(
        "record", F.when(F.col("begun").isNull() | (F.col("begun") == F.col("last_begun")), -1).otherwise(F.col("begun")))
    lost = F.col("unclosed") & (F.col("record") == -1) & (F.col("record_block") == F.col("last_owner"))
    alone = lost | ((F.col("state") == 0) & (_behind(F.col("state")) == 0))
    single = each.filter(alone & (F.trim(F.regexp_replace("value", r"\r$", "")) != "")).select(
        "path", "block", "pos", F.col("value").alias("record"))
    parts = F.array_sort("parts")
    several = each.filter(~alone).groupBy("path", "record_block", "record").agg(
        F.collect_list(F.struct("block", "pos", "value")).alias("parts")).select("path", parts.alias("parts")).select(
        "path", F.get("parts", F.lit(0))["block"].alias("block"), F.get("parts", F.lit(0))["pos"].alias("pos"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    # no regular expression here: bytes that are no UTF-8 have to stay as they are
    return single.unionByName(several).withColumn("record", F.rtrim("record", F.lit("\r")))


def cells_of(record: str) -> list[str]:
    """The cells of a record; the same rules as for lines, and quotes that open or close a cell are dropped."""
    if '"' not in record:
        return record.split(",")
    cells, held, state = [], [], _START
    *segments, rest = record.split('"')
    for segment in segments:
        if state == _INSIDE:
            held.append(segment)
            state = _CLOSED
            continue
        first, *others = segment.split(",")
        held.append(first)
        if others:
            cells += ["".join(held), *others[:-1]]
            held = [others[-1]]
        if segment.endswith(",") or (not segment and state == _START):
            state = _INSIDE
        elif not segment and state == _CLOSED:
            held.append('"')
            state = _INSIDE
        else:
            held.append('"')
            state = _PLAIN
    if state == _INSIDE:
        return [*cells, "".join(held) + rest]
    first, *others = rest.split(",")
    return [*cells, "".join(held) + first, *others]


@F.pandas_udf(ArrayType(StringType()))
def _quoted_cells(records: pd.Series) -> pd.Series:
    return pd.Series([cells_of(r) if isinstance(r, str) else None for r in records], dtype=object)


def record_cells(record: Column) -> Column:
    """The cells of a record; records without a quote are split without leaving the JVM."""
    quoted = F.contains(record, F.lit('"'))
    return F.coalesce(_quoted_cells(F.when(quoted, record)), F.split(record, ",", -1))
