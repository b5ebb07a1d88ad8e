"""Null rules of the relational operators, against pandas on small frames."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tableworks.functions.columns import nan_to_null
from tableworks.operators import relational as rel

ROWS = [("a", 1.0, 2), ("b", None, 0), (None, 3.0, 4), ("a", 0.0, 0), ("c", -1.0, 0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, x double, n int")


def values(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_unequal_keeps_nulls(df):
    assert {r.k for r in rel.filter_rows(df, "k", "!=", "a").collect()} == {"b", None, "c"}


def test_other_comparisons_drop_nulls(df):
    for op, expected in [("==", 1), ("<", 2), ("<=", 3), (">", 1), (">=", 2)]:
        assert rel.filter_rows(df, "x", op, 1.0).count() == expected


def test_number_never_equals_text(df):
    assert rel.filter_rows(df, "n", "==", "2").count() == 0
    assert rel.filter_rows(df, "n", "!=", "2").count() == 5
    with pytest.raises(TypeError):
        rel.filter_rows(df, "n", "<", "2")


def test_empty_condition_lists_keep_all(df):
    assert rel.filter_all(df, []).count() == rel.filter_any(df, []).count() == 5


def test_any_with_null_branch(df):
    assert rel.filter_any(df, [("x", ">", 0.0), ("n", "==", 0)]).count() == 5


def test_unknown_columns_raise(df):
    with pytest.raises(ValueError):
        rel.select(df, "nope")
    with pytest.raises(ValueError):
        rel.order(df, "nope")


def test_division(df):
    null = [r.q for r in rel.derive(df, "q", "x", "/", "n").collect()]
    assert null == [0.5, None, 0.75, None, None]
    ieee = [r.q for r in rel.derive(df, "q", "x", "/", "n", on_zero="ieee").collect()]
    assert ieee[0] == 0.5 and ieee[1] is None and math.isnan(ieee[3]) and ieee[4] == float("-inf")


def test_text_and_numbers_do_not_mix(df):
    with pytest.raises(TypeError):
        rel.derive(df, "q", "k", "+", "x")
    with pytest.raises(TypeError):
        rel.derive(df, "q", "k", "-", "k")


def test_nan_becomes_null(spark):
    frame = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in nan_to_null(frame).collect()] == [None, 1.0]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("split", [True, False])
def test_join_matches_null_keys(spark, how, split):
    left = pd.DataFrame({"k": ["a", "a", None, "b"], "v": [1, 2, 3, 4]})
    right = pd.DataFrame({"k": ["a", None, None, "z"], "v": [5, 6, 7, 8]})
    l = spark.createDataFrame([tuple(r) for r in left.astype(object).values], "k string, v long")
    r = spark.createDataFrame([tuple(r) for r in right.astype(object).values], "k string, v long")
    got = values(rel.join(l, r, ["k"], how, split_outer=split))
    want = left.merge(right, on="k", how=how).astype(object)
    want = sorted((tuple(None if pd.isna(c) else c for c in row) for row in want.values), key=str)
    assert got == want
    assert rel.join(l, r, ["k"], how).columns == ["k", "v_x", "v_y"]


def test_sql_keys(spark):
    l = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v long")
    assert rel.join(l, l, ["k"], nulls="sql").count() == 1


def test_group_output_order_and_null_sum(df):
    out = rel.group_aggregate(df, ["k"], [("sum", "x"), ("max", "n"), ("mean", "x")], ordered=True)
    assert out.columns == ["k", "sum_x", "mean_x", "max_n"]
    rows = out.collect()
    assert [r.k for r in rows] == ["a", "b", "c", None]
    assert rows[1].sum_x == 0 and rows[1].mean_x is None


def test_nulls_last_both_ways(df):
    assert [r.x for r in rel.order(df, "x").collect()][-1] is None
    assert [r.x for r in rel.order(df, "x", ascending=False).collect()][-1] is None


def test_negative_limit(df):
    with pytest.raises(ValueError):
        rel.limit(df, -1)


cells = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1.0, 2.0, -3.0, None])),
                 min_size=1, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(cells)
def test_grouping_equals_pandas(spark, rows):
    frame = spark.createDataFrame(rows, "k string, x double")
    pdf = pd.DataFrame(rows, columns=["k", "x"]).astype({"x": float})
    want = pdf.groupby("k", dropna=False)["x"].agg(["sum", "mean", "count"]).reset_index()
    got = rel.group_aggregate(frame, ["k"], [("sum", "x"), ("mean", "x"), ("count", "x")]).collect()
    assert len(got) == len(want)
    by_key = {None if pd.isna(r.k) else r.k: r for r in want.itertuples()}
    for row in got:
        w = by_key[row.k]
        assert np.isclose(row.sum_x, w.sum) if isinstance(w.sum, float) else True
        assert row.count_x == w.count or row["count_x"] == getattr(w, "count")
        assert (row.mean_x is None) == bool(pd.isna(w.mean))


@pytest.mark.parametrize("nulls", ["match", "sql"])
def test_outer_join_with_hot_keys_on_both_sides(spark, nulls):
    """Keys hot on the left, on the right, on both sides and on one side only; null keys are hot too."""
    keys = lambda spec: [k for k, n in spec for _ in range(n)]
    left = list(enumerate(keys([("l", 300), ("r", 2), ("both", 90), ("only", 200), (None, 80), ("x", 1), ("y", 1)])))
    right = list(enumerate(keys([("l", 3), ("r", 400), ("both", 40), ("other", 300), (None, 5), ("x", 2), ("z", 1)])))
    l = spark.createDataFrame([(k, i) for i, k in left], "k string, v long").repartition(4)
    r = spark.createDataFrame([(k, i) for i, k in right], "k string, w long").repartition(4)
    got = rel.join(l, r, ["k"], "outer", nulls=nulls, hot_rows=20).collect()
    want = rel.join(l, r, ["k"], "outer", nulls=nulls, split_outer=False).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 4000


def test_outer_join_reads_each_table_once(spark):
    """Whole rows are read once; besides, the keys of both sides are counted."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    lines = read("lineitem").selectExpr("l_orderkey as k", "l_quantity", "l_tax")
    orders = read("orders").selectExpr("o_orderkey as k", "o_totalprice", "o_orderstatus")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = rel.join(lines, orders, ["k"], "outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_tax#") and len([x for x in plan.splitlines() if "FileScan" in x and "l_tax" in x]) == 1
    assert len([x for x in plan.splitlines() if "FileScan" in x and "o_totalprice" in x]) == 1
