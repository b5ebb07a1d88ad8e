"""Header alignment: requested column names against the headers of many tables.

``requests`` is ``(req_id, table_id, name)``, ``headers`` is ``(table_id, columns ARRAY<STRING>)``
with one row per table. Each distinct request meets its own table's header once, as an array whose
size is the table's width, so no pairs are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import col
from tableworks.functions.text import squeeze, words

TIERS = ["exact", "case", "quotes", "spaces", "words"]


def _forms(name: Column, quoted: bool) -> Column:
    """The spellings of a name that are compared, made once per name or column."""
    bare = F.regexp_replace(name, "[\"']", "") if quoted else name
    flat = squeeze(bare)
    return F.struct(
        name.alias("exact"),
        F.lower(F.trim(name) if quoted else name).alias("case"),
        F.lower(F.trim(bare) if quoted else name).alias("quotes"),
        F.lower(flat).alias("spaces"),
        words(flat).alias("words"),
        F.char_length(flat if quoted else name).alias("length"),
    )


def _exact_tier(name: Column, column: Column) -> Column:
    """0 exact, 1 other case, 2 quotes removed, 3 white space normalised, else NULL."""
    low = column["case"]
    return (
        F.when(column["exact"] == name["exact"], 0).when(low == name["case"], 1)
        .when(low == name["quotes"], 2).when(column["spaces"] == name["spaces"], 3)
    )


def _word_score(name: Column, column: Column) -> Column:
    """0.5 · share of the name's words + 0.3 · share of the column's words + 0.2 · length likeness.

    The result is a struct (score, common, overlap); fields are NULL without a common word.
    """
    common = F.size(F.array_intersect(name["words"], column["words"]))
    overlap = common / F.size(name["words"])
    likeness = 1 - F.abs(name["length"] - column["length"]) / F.greatest(name["length"], column["length"])
    score = overlap * 0.5 + common / F.size(column["words"]) * 0.3 + likeness * 0.2
    found = common > 0
    return F.struct(
        F.when(found, score).alias("score"), F.when(found, common).alias("common"),
        F.when(found, overlap).alias("overlap"),
    )


def align(requests: DataFrame, headers: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(req_id, table_id, name, column_name, tier, score)``; no match leaves column_name NULL.

    The first exact tier that hits wins, ties by header order. Otherwise, with ``fuzzy``, the best
    word score above 0.3, ties by common words, overlap and header order.
    """
    wanted = requests.select("table_id", "name").distinct().withColumn("n", _forms(col("name"), True))
    offered = headers.select("table_id", F.transform("columns", lambda c: _forms(c, False)).alias("cs"))
    faced = wanted.join(offered, "table_id", "left")
    exact = F.array_min(F.filter(
        F.transform("cs", lambda c, i: F.struct(
            _exact_tier(col("n"), c).alias("tier"), i.alias("pos"), c["exact"].alias("column_name"))),
        lambda x: x["tier"].isNotNull(),
    ))
    scored = F.array_max(F.filter(
        F.transform("cs", lambda c, i: F.struct(
            _word_score(col("n"), c).alias("fit"), (-i).alias("order"), c["exact"].alias("column_name"))),
        lambda x: x["fit"]["score"] > 0.3,
    ))
    found = faced.select("table_id", "name", "n", "cs", exact.alias("exact"))
    if fuzzy:  # only names without an exact match are scored
        found = found.withColumn("scored", F.when(col("exact").isNull(), scored))
        column = F.coalesce(col("exact")["column_name"], col("scored")["column_name"])
        tier = F.coalesce(col("exact")["tier"], F.when(col("scored").isNotNull(), 4))
        score = col("scored")["fit"]["score"]
    else:
        column, tier = col("exact")["column_name"], col("exact")["tier"]
        score = F.lit(None).cast("double")
    label = None
    for i, text in enumerate(TIERS):
        label = F.when(tier == i, text) if label is None else label.when(tier == i, text)
    resolved = found.select("table_id", "name", column.alias("column_name"), label.alias("tier"),
                            score.alias("score"))
    return requests.join(resolved, ["table_id", "name"], "left").select(
        "req_id", "table_id", "name", "column_name", "tier", "score")


def suggestions(misses: DataFrame, headers: DataFrame) -> DataFrame:
    """``(table_id, name, rank, suggestion)`` for names without a match.

    Columns that contain the name or lie in it, in header order; without any, the first five.
    """
    wanted = misses.select("table_id", "name").distinct()
    faced = wanted.join(headers.select("table_id", "columns"), "table_id")
    low = F.lower(col("name"))
    near = F.filter("columns", lambda c: F.contains(F.lower(c), low) | F.contains(low, F.lower(c)))
    listed = F.when(F.size(near) > 0, near).otherwise(F.slice("columns", 1, 5))
    return faced.select("table_id", "name", F.posexplode(listed).alias("rank", "suggestion"))
