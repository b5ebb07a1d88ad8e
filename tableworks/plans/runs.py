"""Run-log analytics.

Result records (one per question and log, with nested runs and steps) become two flat tables:
``runs``, one row per run with the features of its steps, and ``steps``, one row per step. All
reports are groupings of these two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import as_columns, col
from tableworks.operators import ordered, stats

# Labels of decisions, error texts for missing ones, metadata dimensions.
DIMENSIONS = ["reasoning_type", "answerable", "answer_type", "complexity", "distractor_type",
              "has_distractor", "table_number", "domain"]
NO_ERROR = "no_error_field"
UNKNOWN = "UNKNOWN"


def _is_round(step: Column) -> Column:
    """A step whose content is a model response."""
    content = step["content"]
    return (content != "") & ~content.startswith("System:") & ~content.startswith("User:")


def _length(values: Column) -> Column:
    return F.when(values.isNotNull(), F.size(values)).otherwise(0)


def flatten(records: DataFrame) -> DataFrame:
    """One row per run: run index, number of runs, decision, times, final step, rounds, errors.

    The features come from the step arrays of the row itself, so nothing is shuffled. Columns of
    the record other than ``runs`` are kept. A record without runs is one row without index or answer.
    """
    kept = [c for c in records.columns if c != "runs"]
    exploded = records.select(
        *as_columns(kept), F.greatest(F.coalesce(F.size("runs"), F.lit(0)), F.lit(0)).alias("total_runs"),
        F.posexplode_outer("runs").alias("run_index", "_run"))
    run = col("_run")
    last = F.when(F.size(run["steps"]) > 0, F.element_at(run["steps"], -1))
    failed = F.filter(run["steps"], lambda s: s["status"] == "FAILED")
    return exploded.select(
        *as_columns(kept), "run_index", "total_runs",
        run["steps"].alias("steps"), run["llm_answer"].alias("llm_answer"),
        run["llm_valid"]["decision"].alias("decision"),
        run["llm_valid"]["time_s"].alias("time_s"), run["error"].alias("error"),
        F.when(last.isNotNull(), F.coalesce(last["status"], F.lit(UNKNOWN))).alias("status"),
        last["error"].alias("error_code"),
        _length(F.filter(run["steps"], _is_round)).alias("rounds"),
        _length(failed).alias("failed_steps"),
    )


def explode_steps(runs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per step with its index; ``keep`` adds columns of the run."""
    keep = keep or ["question_id", "run_index"]
    return runs.select(*as_columns(keep), F.posexplode("steps").alias("step_index", "s")).select(
        *as_columns(keep), "step_index", "s.*")


def decision_label(decision: Column) -> Column:
    return F.when(decision, "SUCCESS").when(~decision, "FAILED").otherwise("NULL_ANSWER")


def filter_questions(runs: DataFrame, ids: list[int]) -> DataFrame:
    """Runs of the numbered questions; an empty list keeps all."""
    if not ids:
        return runs
    return runs.filter(col("question_id").isin([f"question_{i:03d}" for i in ids]))


def with_metadata(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Question metadata next to each run (left join, the first record of a question by path).

    Spark broadcasts the question side when its measured size allows; AQE splits a question that
    has very many runs otherwise.
    """
    score = F.coalesce(col("complexity_metrics")["complexity_score"], F.lit(0.0))
    from tableworks.plans.questions import complexity_tier
    facts = [c for c in DIMENSIONS if c != "complexity"]
    meta = questions.withColumn("complexity", complexity_tier(score)).groupBy("question_id").agg(
        F.min_by(F.struct(*facts, "complexity"), col("_path")).alias("_m"))
    return runs.join(meta, "question_id", "left").select("*", "_m.*").drop("_m")


def overview(runs: DataFrame) -> DataFrame:
    """Numbers of runs and questions, success rate, rounds and errors, as one row."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_distinct("question_id").alias("unique_questions"),
        stats.rate(col("decision")).alias("success_rate"),
        F.coalesce(F.sum("rounds"), F.lit(0)).alias("total_rounds"),
        F.avg("rounds").alias("mean_rounds"),
        F.coalesce(F.sum("failed_steps"), F.lit(0)).alias("total_failed_steps"),
        F.avg("failed_steps").alias("mean_failed_steps"),
        F.count_if(col("llm_answer").isNull()).alias("null_answers"),
    )


def decision_distribution(runs: DataFrame) -> DataFrame:
    return stats.value_counts(runs.select(decision_label(col("decision")).alias("label")), "label")


def status_distribution(steps: DataFrame) -> DataFrame:
    return stats.value_counts(steps, "status")


def error_distribution(steps: DataFrame) -> DataFrame:
    """SUCCESS steps and the error codes of FAILED steps, counted together as ``code``."""
    error = F.nullif("error", F.lit(""))
    code = F.when(col("status") == "SUCCESS", "SUCCESS").when(col("status") == "FAILED", error)
    return stats.value_counts(steps.select(code.alias("code")), "code")


def rounds_histogram(runs: DataFrame) -> DataFrame:
    return runs.groupBy("rounds").agg(F.count(F.lit(1)).alias("runs"))


def failed_step_errors(steps: DataFrame) -> DataFrame:
    """Failed steps per error; a missing error text is ``UNKNOWN``."""
    failed = steps.filter(col("status") == "FAILED")
    return stats.value_counts(
        failed.select(F.coalesce("error", F.lit(UNKNOWN)).alias("error")), "error")


def errors_by_question(runs: DataFrame) -> DataFrame:
    return runs.groupBy("question_id").agg(F.sum("failed_steps").alias("errors"))


def null_answer_errors(runs: DataFrame) -> DataFrame:
    """Runs without an answer per error text; a missing one is ``no_error_field``."""
    empty = runs.filter(col("llm_answer").isNull())
    return stats.value_counts(empty.select(F.coalesce("error", F.lit(NO_ERROR)).alias("error")), "error")


def run_time(runs: DataFrame) -> Column:
    """Execution time where the runs have it, else the time of the validation."""
    return F.coalesce("execution_time", "time_s") if "execution_time" in runs.columns else col("time_s")


def time_statistics(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return stats.describe(runs.withColumn("time", run_time(runs)), ["time"], by)


def by_dimension(runs: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Success rate, count and time statistics per value of each dimension; nulls are left out.

    Runs are turned into (dimension, value) rows once and grouped once, combined on the map side.
    """
    long = _by_value(runs, dimensions, [run_time(runs).alias("time"), col("decision")])
    keys = ["dimension", "value"]
    return ordered.quantiles(long, keys, "time", {"median_time": 0.5}, also=[
        F.count(F.lit(1)).alias("count"), stats.rate(col("decision")).alias("success_rate"),
        # exact to the microsecond, so that the order of the rows does not matter
        F.avg(col("time").cast("decimal(18,6)")).cast("double").alias("mean_time"),
        F.stddev_samp("time").alias("std_time"),
        F.min("time").alias("min_time"), F.max("time").alias("max_time")])


def errors_by_dimension(runs: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Runs per final error code within each value of each dimension."""
    long = _by_value(runs, dimensions, [col("error_code")]).filter(col("error_code").isNotNull())
    return long.groupBy("dimension", "value", "error_code").agg(F.count(F.lit(1)).alias("count"))


def _by_value(runs: DataFrame, dimensions: list[str] | None, keep: list[Column]) -> DataFrame:
    names = dimensions or [d for d in DIMENSIONS if d in runs.columns]
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dimension"), col(d).cast("string").alias("value")) for d in names])
    return runs.select(F.explode(pairs).alias("_p"), *keep).select("_p.*", "*").drop("_p").filter(
        col("value").isNotNull())


def consistency_by_question(runs: DataFrame) -> DataFrame:
    """Questions with several runs: whether all decisions agree (missing ones count), and how."""
    grouped = runs.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(col("decision")).alias("n_true"),
        F.count_if(~col("decision")).alias("n_false"),
    ).filter("runs > 1")
    kind = (
        F.when(col("n_true") == col("runs"), "all_success")
        .when(col("n_false") == col("runs"), "all_error")
        .when(col("n_true") + col("n_false") == 0, "all_null").otherwise("mixed")
    )
    return grouped.withColumn("kind", kind).withColumn("consistent", col("kind") != "mixed")


def consistency(runs: DataFrame) -> DataFrame:
    """Numbers and rates of consistent questions, as one row."""
    found = consistency_by_question(runs)
    kinds = ["all_success", "all_error", "all_null", "mixed"]
    total = found.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("consistent").alias("consistent"),
        *[F.count_if(col("kind") == k).alias(k) for k in kinds])
    return total.select("*", *[
        F.coalesce(F.try_divide(col(k).cast("double"), col("questions")), F.lit(0.0)).alias(f"{k}_rate")
        for k in ["consistent", *kinds]])


def consistency_detail(runs: DataFrame) -> DataFrame:
    """Every run of the questions with several runs, next to its question's verdict.

    Kept as rows: a question may have any number of runs.
    """
    verdict = consistency_by_question(runs).select("question_id", "runs", "consistent", "kind")
    return runs.select("question_id", "run_index", "decision", "status", "error_code").join(
        verdict, "question_id")


def status_success(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of all runs whose final status is SUCCESS, overall or per group; no status is no success."""
    return stats.rate_by(runs, by or [], F.coalesce(col("status") == "SUCCESS", F.lit(False)))


def top_errors(runs: DataFrame, n: int = 5) -> DataFrame:
    return stats.value_counts(runs, "error_code", n)


def time_histogram(runs: DataFrame) -> DataFrame:
    return stats.histogram(runs.select(run_time(runs).alias("time")), "time")


def compare_sources(runs: DataFrame, sources: list[str], source: str = "source_dir") -> DataFrame:
    """The same measures for several result sets side by side: one row per measure."""
    measured = runs.groupBy(col(source).alias("source")).agg(
        F.count(F.lit(1)).cast("double").alias("runs"),
        stats.rate(col("decision")).alias("success_rate"),
        F.avg("rounds").alias("mean_rounds"), F.avg("failed_steps").alias("mean_failed_steps"),
        F.avg(run_time(runs)).alias("mean_time"),
    )
    names = [c for c in measured.columns if c != "source"]
    long = stats.long_form(measured, names, "measure", "number", ["source"], "double")
    return long.groupBy("measure").pivot("source", sources).agg(F.first("number"))


def repeated_plans(steps: DataFrame, threshold: int = 3) -> DataFrame:
    """Plans that a run executed at least ``threshold`` times."""
    return steps.filter(col("content").isNotNull()).groupBy("question_id", "run_index", "content").agg(
        F.count(F.lit(1)).alias("times")).filter(col("times") >= threshold)


def stubborn_plans(steps: DataFrame, threshold: int = 3, stop: int = 5) -> DataFrame:
    """Plans that failed at least ``threshold`` times in a run, and whether that ended the run."""
    failed = steps.filter((col("status") == "FAILED") & col("content").isNotNull())
    return failed.groupBy("question_id", "run_index", "content").agg(
        F.count(F.lit(1)).alias("failures")).filter(col("failures") >= threshold).withColumn(
        "stopped", col("failures") >= stop)


def timeout_streaks(
    questions: DataFrame, by: list[str], order: list[str], timeouts: Column, stop: int = 3,
) -> DataFrame:
    """Timeouts added up over consecutive questions with timeouts, and where that reaches the stop."""
    return ordered.streaks(questions, by, order, timeouts, "streak").withColumn(
        "stopped", col("streak") >= stop)
