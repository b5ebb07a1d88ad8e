"""Cleaning steps and verdicts on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tableworks.functions.text import clean_group_name, integer_of, money_number_of, number_of
from tableworks.operators import cleaning, profiling
from tableworks.operators.cleaning import Policy

SCHEMA = "Entity string, Year long, v double, t string, pos long"


def table(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


GOOD = [("a", 2000, 1.0, "$1,000"), ("a", 2000, 1.0, "$1,000"), ("b", 2001, None, "50%"),
        (None, 2002, 5.0, "7"), ("c", 2003, 9.0, " 8 "), ("d", 2004, 2.0, "3"), ("e", 2005, 4.0, "1e3"),
        (None, None, None, None)]


def test_keep_na(spark):
    result = cleaning.clean(table(spark, GOOD), ["pos"], Policy())
    rows = {r.Entity: r for r in result.table.collect()}
    assert set(rows) == {"a", "b", "c", "d", "e"} and rows["a"].pos == 0
    assert rows["b"].v is None and rows["a"].t == 1000.0 and rows["b"].t == 50.0 and rows["e"].t == 1000.0
    report = result.report.first()
    assert report.passed and report.original_rows == 8 and report.final_rows == 5
    assert report.data_completeness == pytest.approx(19 / 20)


def test_mean_and_mode(spark):
    rows = [("a", 2000, 1.0, "x"), ("b", 2001, None, None), ("c", 2002, 5.0, "y"), ("d", 2003, 6.0, "y"),
            ("e", None, 3.0, "x"), ("f", 2005, 3.0, "z"), ("g", 2006, 0.0, "z")]
    policy = Policy(numeric="mean", categorical="mode")
    got = {r.Entity: (r.v, r.t) for r in cleaning.clean(table(spark, rows), ["pos"], policy).table.collect()}
    assert "e" not in got and got["b"] == (3.0, "x")
    median = cleaning.clean(table(spark, rows), ["pos"], Policy(numeric="median", categorical="mode"))
    assert {r.Entity: r.v for r in median.table.collect()}["b"] == 3.0


def test_verdicts(spark):
    few = cleaning.clean(table(spark, GOOD[:3]), ["pos"])
    assert few.table is None and few.report.first().reason == "too small"
    texts = spark.createDataFrame([(f"e{i}", "x", f"y{i}", i) for i in range(6)],
                                  "Entity string, a string, b string, pos long")
    verdict = cleaning.clean(texts, ["pos"]).report.first()
    assert not verdict.passed and verdict.reason == "too few numeric columns" and verdict.final_rows == 0
    strict = Policy(numeric="mean", categorical="mode", min_completeness=0.99)
    sparse = [(f"e{i}", i, 1.0, None if i else "only") for i in range(6)]
    assert cleaning.clean(table(spark, sparse), ["pos"], strict).report.first().passed


def test_name_clash(spark):
    frame = spark.createDataFrame([(1, 2)], "`a  b` int, ` a b` int")
    with pytest.raises(ValueError):
        cleaning.standard_names(frame)


def test_entity_cap_ties_and_nulls(spark):
    frame = spark.createDataFrame([(e,) for e in ["b", "b", "a", "c", "c", "d", None]], "Entity string")
    got = sorted((r.Entity for r in cleaning.cap_entities(frame, "Entity", 3).collect()))
    assert got == ["a", "b", "b", "c", "c"]
    assert cleaning.cap_entities(frame, "Entity", 4).count() == 7


def test_corpus_equals_single_table(spark):
    frame = table(spark, GOOD)
    rows = profiling.corpus_rows(frame, "t", "pos", ["Entity", "Year", "v", "t"])
    headers = profiling.corpus_headers(spark, {"t": ["Entity", "Year", "v", "t"], "u": ["x", "y"]})
    corpus = cleaning.clean_corpus(rows, headers)
    both = {r.table_id: r for r in corpus.report.collect()}
    one = cleaning.clean(frame, ["pos"], name="t").report.first()
    assert both["t"].asDict() == one.asDict()
    assert both["u"].reason == "too small" and corpus.headers.count() == 1
    assert {r.pos for r in corpus.rows.collect()} == {0, 2, 4, 5, 6}


def test_number_parsing(spark):
    texts = ["1", " 5 ", "1e3", "-.5", "1d", "nan", "", "12abc", "inf", "$1,200.5", "7%", None, "1.", "+3"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(number_of(F.col("t")).alias("n"), money_number_of(F.col("t")).alias("m"),
                       integer_of(F.col("t")).alias("i")).collect()
    inf = float("inf")
    assert [r.n for r in got] == [1.0, 5.0, 1000.0, -0.5, None, None, None, None, inf, None, None, None, 1.0, 3.0]
    assert [r.m for r in got][9:11] == [1200.5, 7.0]
    assert [r.i for r in got][:3] == [1, 5, None]


def test_group_names(spark):
    names = {"health & care: costs": "Health_Care_Costs", "!!!": "Untitled_Group", "a-b  c": "A-b_C",
             "x" * 40 + " " + "y" * 40: "X" + "x" * 39, "z" * 70: "Z" + "z" * 59}
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.c for r in frame.select("n", clean_group_name(F.col("n")).alias("c")).collect()}
    assert got == names


def test_profile_types(spark):
    headers = profiling.corpus_headers(spark, {"t": ["a", "b", "c", "d"]})
    rows = spark.createDataFrame(
        [("t", 1, [None, "1", "x", "true"]), ("t", 0, ["2", "1.5", None, "False"])],
        "table_id string, pos long, cells array<string>")
    columns = profiling.with_first_values(profiling.column_profile(rows, headers), rows)
    got = {r.column_name: (r.dtype, r.n_nulls, r.sample_value) for r in columns.collect()}
    assert got == {"a": ("float64", 1, "2"), "b": ("float64", 0, "1.5"), "c": ("object", 1, "x"),
                   "d": ("bool", 0, "False")}


def test_rows_of_a_table_are_not_gathered(spark):
    """Facts per table and column are broadcast to the rows."""
    rows = profiling.corpus_rows(table(spark, GOOD), "t", "pos", ["Entity", "Year", "v", "t"])
    headers = profiling.corpus_headers(spark, {"t": ["Entity", "Year", "v", "t"]})
    joins = lambda df, kind: [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()
                              if f"Join {kind}" in line]
    decided = joins(cleaning.corpus_decisions(rows, headers, cleaning.Policy(numeric="median", categorical="mode")), "Inner")
    assert len(decided) >= 2 and all("strategy=broadcast" in line for line in decided)
    cleaned = joins(cleaning.clean_corpus(rows, headers).rows, "LeftSemi")
    assert cleaned and all("strategy=broadcast" in line for line in cleaned)


def test_types_are_broadcast_to_the_rows(spark):
    rows = profiling.corpus_rows(table(spark, GOOD), "t", "pos", ["Entity", "Year", "v", "t"])
    headers = profiling.corpus_headers(spark, {"t": ["Entity", "Year", "v", "t"]}, {"t": ["text", "int", None, None]})
    plan = profiling.column_profile(rows, headers)._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Join Inner" in line and "strategy=broadcast" in line]


def test_report_without_caps_moves_no_cells(spark, monkeypatch):
    """Equal rows count once in the report; rows that differ in where a cell is missing, or in a sign or scale, are not equal."""
    cells = [["a", "1", "x", "2"], ["a", "1.0", "x", "2"], ["a", "1", None, "2"], ["a", "1", "2", None], ["a", None, "1", "2"],
             ["b", "-0.0", "x", "2"], ["b", "0.0", "x", "2"], ["b", "NaN", "x", "2"], ["ab", "3", "c", "2"], ["a", "3", "bc", "2"],
             ["a", "1", "x", "2"], [None, "5", "x", "2"], [None] * 4]
    pinned, pin = [], cleaning.pin
    monkeypatch.setattr(cleaning, "pin", lambda df: pinned.extend(df.columns) or pin(df))
    rows = spark.createDataFrame([(t, i, c) for t in ("t", "u") for i, c in enumerate(cells)], "table_id string, pos long, cells array<string>")
    names = ["Entity", "n", "m", "k"]
    for types in (None, {"t": ["text", "float", "text", "int"]}):
        headers = profiling.corpus_headers(spark, {"t": names, "u": names}, types)
        policy = cleaning.Policy(min_numeric_columns=0)
        corpus = cleaning.clean_corpus(rows, headers, policy)
        report = {r.table_id: (r.passed, r.final_rows, round(r.data_completeness, 6)) for r in corpus.report.collect()}
        for t in ("t", "u"):
            left = corpus.rows.filter(F.col("table_id") == t).collect()
            filled = sum(c is not None for r in left for c in r.cells)
            assert report[t] == (True, len(left), round(filled / len(left) / 4, 6)) and 8 <= len(left) < 11
    assert "cells" not in pinned


def test_known_numbers_are_read_as_their_texts_are(spark):
    """A column of numbers gives the same report and rows whether its type is told or found."""
    cells = [["a", "1", "1.5"], ["b", "-2", "NaN"], ["c", "3", "Infinity"], ["d", None, "1.0E10"], ["e", "5", None], ["e", "5", None]]
    rows = spark.createDataFrame([("t", i, c) for i, c in enumerate(cells)], "table_id string, pos long, cells array<string>")
    made = []
    for types in (None, {"t": ["text", "int", "float"]}, {"t": [None, "int", None]}):
        corpus = cleaning.clean_corpus(rows, profiling.corpus_headers(spark, {"t": ["Entity", "n", "x"]}, types))
        made.append((corpus.report.collect(), sorted(map(str, corpus.rows.collect()))))
    assert made[0][1] == made[2][1] and made[0][0] == made[2][0] and len(made[0][1]) == 5
