"""The physical plans the operators are written for."""

import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "flagship")
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "EqualTo(l_returnflag,R)" in text
    assert "l_comment" not in text and "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["head_per_table", "head_tail_balanced", "sample_seeded_per_table"])
def test_group_limits_act_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .* Partial", plan(spark, name))


@pytest.mark.parametrize("name", ["order_limit_topk", "cap_rows", "sample_seeded", "top_categories"])
def test_top_k_is_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", [
    "derive_agg_scalar", "share_minor", "time_hist", "resume_from", "join_null_keys", "align_headers",
    "table_percentages", "index_statistics", "consistency", "match_titles", "anti_new_only",
])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["profile_columns", "complexity_level", "step_status"])
def test_aggregates_are_hashed(spark, name):
    assert "SortAggregate" not in plan(spark, name)
