"""Nothing is lost or aborted by one odd value."""

import pytest
from pyspark.sql import functions as F

from tableworks.functions.answers import classify_response
from tableworks.functions.text import integer_of
from tableworks.operators import cleaning, relational
from tableworks.plans import answers, questions, runs


def test_integers_of_64_bits(spark):
    df = spark.createDataFrame([("1234567890123456789",), ("-9223372036854775808",), ("9223372036854775808",), ("7x",)], "t string")
    got = [r.i for r in df.select(integer_of(F.col("t")).alias("i")).collect()]
    assert got == [1234567890123456789, -9223372036854775808, None, None]


def test_long_identifiers_stay_in_a_corpus(spark):
    rows = [("t", n, ["a" + str(n), str(1234567890123456780 + n), str(n / 2)]) for n in range(8)]
    table = spark.createDataFrame(rows, "table_id string, pos long, cells array<string>")
    headers = spark.createDataFrame([("t", ["Entity", "id", "v"])], "table_id string, columns array<string>")
    corpus = cleaning.clean_corpus(table, headers)
    ids = sorted(r.cells[1] for r in corpus.rows.collect())
    assert ids == [str(1234567890123456780 + n) for n in range(8)]


def test_records_without_runs_are_kept(spark):
    step = "struct<content:string,status:string,error:string,guidance:string,result:string>"
    schema = (f"question_id string, runs array<struct<steps:array<{step}>,llm_answer:string,"
              "llm_valid:struct<decision:boolean,time_s:double,retried:boolean,error:string>,error:string>>")
    one = ([("x", "SUCCESS", None, None, None)], "4", (True, 1.0, False, None), None)
    flat = runs.flatten(spark.createDataFrame([("a", [one]), ("b", None), ("c", [])], schema))
    got = {r.question_id: (r.total_runs, r.run_index, r.rounds) for r in flat.collect()}
    assert got == {"a": (1, 0, 1), "b": (0, None, 0), "c": (0, None, 0)}
    assert runs.status_success(flat).first()["count"] == 3


def test_bad_tokens_and_wide_ranges(spark):
    specs = spark.createDataFrame([("l", 0, "12345678901234567890,3-1,x,1-25000")], "list string, at int, spec string")
    got = questions.expand_ids(specs, "list", "spec", "at")
    assert got.count() == 25_000
    assert [r.id for r in got.orderBy("rank").limit(4).collect()] == [1, 2, 3, 4]


def test_name_clash_is_a_verdict(spark):
    df = spark.createDataFrame([(n, "a", n, float(n)) for n in range(9)], ["pos", "Entity", "v  x", "v x"])
    done = cleaning.clean(df, ["pos"])
    assert done.table is None and not done.report.first().passed


def test_lists_of_a_million_values(spark):
    """Chunks and digests without a row that holds the list."""
    def values(least):
        return spark.range(least, 1_000_000).select(F.lit("q").alias("k"), F.format_string("%07d", "id").alias("value"))

    chunks = answers.answer_chunks(values(0), ["k"])
    assert "collect_list" not in chunks._jdf.queryExecution().executedPlan().toString()
    whole = answers.list_digests(chunks, ["k"]).first()
    assert whole.n_values == 1_000_000 and chunks.count() == 1000
    other = answers.answer_chunks(values(0).repartition(5), ["k"], 700)
    assert answers.same_long_lists(chunks, other, ["k"]).first().same
    row = answers.same_long_lists(chunks, answers.answer_chunks(values(1), ["k"]), ["k"]).first()
    assert not row.same and (row.n_left, row.n_right) == (1_000_000, 999_999)


def test_long_lists_are_written_out(spark):
    values = spark.range(10_050).select(F.lit("q").alias("k"), F.format_string("%05d", "id").alias("value"))
    row = answers.list_answers(values, ["k"]).first()
    assert row.n_values == 10_050 and row.answer.count(",") == 10_049


def test_no_caps_by_default(spark):
    df = spark.range(1500).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("Entity"),
                                  F.col("id").alias("a"), (F.col("id") / 2).alias("b"))
    assert cleaning.clean(df, ["pos"]).table.count() == 1500


def test_end_in_any_case(spark):
    df = spark.createDataFrame([("end\n42\nend",), ("END\n42\nEND",)], "t string")
    got = {tuple(r.c) for r in df.select(classify_response(F.col("t")).alias("c")).collect()}
    assert got == {("END", "42")}


def test_hot_key_on_the_right_is_one_row(spark):
    left, right = spark.range(5).withColumnRenamed("id", "k"), spark.range(2000).select((F.col("id") % 2).alias("k"))
    assert relational.semi(left, right, ["k"]).count() == 2 and relational.anti(left, right, ["k"]).count() == 3
    plan = relational.semi(left, right, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan


def test_ranges_beyond_reason_raise(spark):
    specs = spark.createDataFrame([("a", 1, "1-9000000000000000000")], "list string, at int, spec string")
    with pytest.raises(Exception, match="range too wide"):
        questions.expand_ids(specs, "list", "spec", "at").count()
