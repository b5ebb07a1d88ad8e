"""Running totals, positions, quantiles and streaks with one hot group that spans all pieces."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableworks.operators import ordered, sampling, stats

pytestmark = pytest.mark.usefixtures("many_pieces")


@pytest.fixture(scope="module")
def data():
    random.seed(3)
    keys = ["hot"] * 400 + [None] * 50 + [f"k{i % 40}" for i in range(350)]
    random.shuffle(keys)
    return pd.DataFrame({"k": keys, "at": range(len(keys)),
                         "v": [random.choice([0.0, 1.0, 2.5, 7.0]) for _ in keys]})


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [tuple(r) for r in data.astype(object).values]
    return spark.createDataFrame(rows, "k string, at long, v double").repartition(5)


def test_hot_group_is_cut_into_pieces(df):
    pieces = ordered.range_pieces(df, ["k"], ["at"])
    assert pieces.filter("k = 'hot'").select("_piece").distinct().count() > 1


def test_positions(df, data):
    got = {r["at"]: r.position for r in ordered.positions(df, ["at"], ["k"]).collect()}
    want = data.groupby("k", dropna=False).cumcount() + 1
    assert got == dict(zip(data["at"], want))


def test_batches_cover_everything(df):
    rows = ordered.batches(df, ["at"], 16).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 801))
    assert [(r.batch, r.batch_position) for r in rows] == [(i // 16 + 1, i % 16 + 1) for i in range(800)]


def test_quantiles(df, data):
    got = {r.k: (r.q, r.m) for r in ordered.quantiles(df, ["k"], "v", {"q": 0.1, "m": 0.5}).collect()}
    for k, part in data.groupby("k", dropna=False):
        assert got[None if pd.isna(k) else k] == pytest.approx((part.v.quantile(0.1), part.v.median()))


def test_approximate_quantiles(df):
    row = ordered.quantiles(df, [], "v", {"m": 0.5}, exact=False).first()
    assert row.m in (0.0, 1.0, 2.5)


def test_streaks(df, data):
    got = {r["at"]: r.streak for r in ordered.streaks(df, ["k"], ["at"], F.col("v").cast("int")).collect()}
    running = {}
    for k, at, v in data.itertuples(index=False):
        key = "null" if pd.isna(k) else k
        running[key] = running.get(key, 0) + int(v) if int(v) else 0
        assert got[at] == running[key]


def test_head_and_tail(df, data):
    for n in (1, 2, 5, 1000):
        got = sorted(r["at"] for r in sampling.head_and_tail(df, ["k"], ["at"], n).collect())
        want = []
        for _, part in data.groupby("k", dropna=False):
            ats = list(part["at"])
            want += ats if n >= len(ats) else ats[:1] if n == 1 else ats[:n // 2] + ats[-(n - n // 2):]
        assert got == sorted(want)


def test_samples_repeat_under_any_partitioning(df):
    one = [r["at"] for r in sampling.sample(df, ["at"], 50, 1).collect()]
    assert one == [r["at"] for r in sampling.sample(df.repartition(3), ["at"], 50, 1).collect()]
    assert one != [r["at"] for r in sampling.sample(df, ["at"], 50, 2).collect()]
    assert sampling.shuffle(df, ["at"], 1).count() == 800


def test_histogram_matches_numpy(df, data):
    import numpy as np
    counts, edges = np.histogram(data.v, bins=10)
    rows = stats.histogram(df, "v", 10).orderBy("bin").collect()
    assert [r["count"] for r in rows] == list(counts)
    assert [r.low for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_one_value(spark):
    rows = stats.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v").orderBy("bin").collect()
    assert len(rows) == 10 and sum(r["count"] for r in rows) == 4 and rows[0].low == 2.5


def test_boxplot_outliers(spark):
    frame = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "k string, v double")
    row = stats.boxplot(frame, ["k"], "v").first()
    assert (row.q1, row.median, row.q3, row.whisker_high, row.outliers) == (2.25, 3.5, 4.75, 5.0, 1)


@pytest.mark.parametrize("accuracy", [40, 400])
def test_bracketed_quantiles(spark, accuracy):
    """Groups of more values than a sketch brackets by all of them: exact all the same."""
    random.seed(5)
    rows = [(random.choice(["a", "b", None]), v) for v in
            [random.gauss(0, 1) for _ in range(6000)] + [float(random.randrange(5)) for _ in range(6000)]
            + [10.0 ** random.uniform(-300, 300) for _ in range(3000)] + [-7.0] * 4000]
    rows += [("few", float(v)) for v in (3, 1, 2)] + [("none", None)] * 3
    frame = pd.DataFrame(rows, columns=["k", "v"])
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    at = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    found = ordered.quantiles(df, ["k"], "v", at, accuracy=accuracy, also=[F.count("*").alias("n")])
    got = {r.k: r for r in found.collect()}
    for k, part in frame.groupby("k", dropna=False):
        row = got[None if pd.isna(k) else k]
        assert row.n == len(part)
        if k == "none":
            assert row.q2 is None
        else:
            assert [row[q] for q in at] == pytest.approx([part.v.quantile(p) for p in at.values()], rel=1e-12)
    whole = ordered.quantiles(df, [], "v", at, accuracy=accuracy).first()
    assert list(whole) == pytest.approx([frame.v.quantile(p) for p in at.values()], rel=1e-12)


def test_quantiles_pin_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (stats.describe(docs, ["n_chars"], ["lang"]), stats.boxplot(docs, ["lang"], "n_chars")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and "NestedLoop" not in plan and "rangepartitioning" not in plan


def test_quantiles_never_broadcast_the_rows(spark, tmp_path):
    """Files that look small may hold many rows; only the facts of the groups are broadcast."""
    spark.range(2000).selectExpr("concat('g', id % 40) as k", "cast(id % 7 as double) as v").write.parquet(f"{tmp_path}/rows")
    found = ordered.quantiles(spark.read.parquet(f"{tmp_path}/rows"), ["k"], "v", {"median": 0.5})
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and all("Join LeftOuter" in line for line in joins)
    assert found.count() == 40


def test_descriptions_are_not_dealt_by_column(spark):
    rows = spark.range(3000).selectExpr("id % 50 as a", "id % 7 / 2 as b")
    found = stats.describe(rows, ["a", "b"])
    assert {r.column: r.median for r in found.collect()} == {"a": 24.5, "b": 1.5}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Initial Plan")[0]
    assert "ResolvedHint (strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString()
