"""Shared folder and lineage cuts."""

import pytest

from tableworks import session


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    master = "spark://cluster:7077"

    def getCheckpointDir(self):
        return None


class _Cluster:
    conf, sparkContext = _Conf(), _Context()


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        session.shared_dir(_Cluster())


def test_pin_keeps_rows_and_cuts_lineage(spark):
    df = session.pin(spark.range(10).withColumnRenamed("id", "v"))
    assert df.count() == 10
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_scratch_paths_differ(spark):
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_broadcast_only_when_few(spark):
    small = session.broadcast_if_few(spark.range(10), 10)
    large = session.broadcast_if_few(spark.range(11), 10)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small) and not hinted(large)


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_hot_key_join_is_whole(spark, how):
    """A third of all rows share one key; the join is cut by adaptive execution and stays whole."""
    from tableworks.operators import relational as rel
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    session.configure(spark)
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 300_000, 1, 8).selectExpr("if(id % 3 = 0, -1, id) as k", "sha2(cast(id as string), 256) as v")
        right = spark.range(0, 150_000, 1, 8).selectExpr("if(id = 0, -1, id * 4) as k", "id as w")
        joined = rel.join(left, right, ["k"], how)
        counted = joined.groupBy().count().first()[0]
        matched = 100_000 + sum(1 for i in range(1, 300_000) if i % 3 and i % 4 == 0)
        want = {"inner": matched, "left": 300_000,
                "outer": 300_000 + 150_000 - 1 - sum(1 for i in range(1, 300_000) if i % 3 and i % 4 == 0)}
        assert counted == want[how]
        joined.collect() if how == "inner" else None
        if how == "inner":
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_full_outer_join_hands_rows_on_one_by_one(spark):
    """Generated code of this join would hold all joined rows of a key at once."""
    session.configure(spark)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(2_000).selectExpr("id % 2 as k", "id as v")
        joined = left.join(left.select("k", left["v"].alias("w")), "k", "full")
        assert len(joined.collect()) == 2_000_000
        plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins and not any("*(" in line for line in joins)
