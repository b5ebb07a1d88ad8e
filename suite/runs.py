"""Run-log analytics, answer scoring and response logs.

Each order is one result record with one to three runs and up to five steps per run; customers stand
in for questions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import read
from tableworks.functions import answers as answer
from tableworks.functions.columns import col
from tableworks.operators import stats
from tableworks.plans import answers, runs
from tableworks.session import scratch_path
from tableworks.sources import readers, sinks
from tableworks.streaming import run_logs

# Expressions both engines understand: {m} is a number of the run, {s} one of the step, {j} the step.
_M = "(o_orderkey * 7 + {i} * 13 + o_custkey) % 10"
_S = "(o_orderkey * 3 + {i} * 5 + case when {j} < 3 then 0 else 7 end) % 11"
_DECISION_OF = """case o_orderstatus
  when 'F' then case when {m} < 7 then true when {m} < 9 then false end
  when 'O' then case when {m} < 4 then true when {m} < 9 then false end
  else case when {m} < 2 then true when {m} < 5 then false end end"""
_STATUS_OF = "case when {s} < 7 then 'SUCCESS' else 'FAILED' end"
_CODE_OF = "case {s} when 7 then 'PLAN_SYNTAX' when 8 then 'EXEC_ERROR' when 9 then 'FORMAT_NO_BLOCK' end"
_CONTENT_OF = """case when {j} = 3 then 'System: wait' when {j} = 4 then ''
  else concat('plan ', cast({s} % 3 as varchar(9))) end"""
# the same over the columns of orders, for run {i} and step {j}
_DECISION = _DECISION_OF.format(m=_M)
_ANSWER = f"case when ({_DECISION}) is not null then concat('answer ', cast({_M} as varchar(9))) end"
_ERROR = f"case when ({_DECISION}) is null and {_M} % 2 = 1 then 'aborted_no_end' end"
_STATUS = _STATUS_OF.format(s=_S)
_CODE = _CODE_OF.format(s=_S)
_CONTENT = _CONTENT_OF.format(s=f"({_S})", j="{j}")


_STORED: dict[tuple[str, str], str] = {}


def _records(spark, folder):
    """Nested result records, one per order, stored once per session as a run would leave them."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        path = scratch_path(spark, "result-records")
        _made_records(spark, folder).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _made_records(spark, folder):
    step = ", ".join(f"'{n}', {e.format(i='i', j='j')}" for n, e in [
        ("content", _CONTENT), ("status", _STATUS), ("error", _CODE)])
    run = f"""named_struct('steps', transform(filter(sequence(0, 4), j -> j < (o_orderkey + i) % 6),
        j -> named_struct({step}, 'guidance', cast(null as string), 'result', cast(null as string))),
      'llm_answer', {_ANSWER.format(i='i')},
      'llm_valid', named_struct('decision', {_DECISION.format(i='i')}, 'time_s', o_totalprice / 1000 + i,
        'retried', false, 'error', cast(null as string)),
      'error', {_ERROR.format(i='i')})"""
    return read(spark, folder, "orders").select(
        F.format_string("question_%03d", "o_custkey").alias("question_id"),
        col("o_orderpriority").alias("source_dir"), "o_orderkey",
        F.expr(f"transform(filter(sequence(0, 2), i -> i < 1 + o_orderkey % 3), i -> {run})").alias("runs"))


def _runs(spark, folder):
    return runs.flatten(_records(spark, folder))


def _steps(spark, folder):
    return runs.explode_steps(_runs(spark, folder), ["question_id", "o_orderkey", "run_index"])


def _questions(spark, folder):
    """Metadata of the questions: one customer each, no question for some customers."""
    return read(spark, folder, "customer").select(
        F.format_string("question_%03d", "c_custkey").alias("question_id"),
        col("c_mktsegment").alias("reasoning_type"), (col("c_acctbal") > 0).alias("answerable"),
        F.lit("numerical").alias("answer_type"),
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("distractor_type"),
        (col("c_nationkey") > 12).alias("has_distractor"),
        (col("c_nationkey") % 3 + 1).cast("int").alias("table_number"),
        col("c_nationkey").cast("string").alias("domain"),
        F.struct((F.col("c_acctbal") / 300).alias("complexity_score")).alias("complexity_metrics"),
        col("c_name").alias("_path"),
    ).filter("reasoning_type <> 'FURNITURE'")


def _rounded(df, places=4):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else col(c) for c, t in df.dtypes])


def runs_flatten(spark, folder):
    df = _runs(spark, folder).withColumn("label", runs.decision_label(col("decision")))
    return df.drop("steps", "source_dir").withColumn("time_s", F.round("time_s", 6))


def final_status(spark, folder):
    return stats.value_counts_long(_runs(spark, folder), ["status", "error_code"])


def runs_of_questions(spark, folder):
    """Runs of a list of question numbers, as the reports allow."""
    df = runs.filter_questions(_runs(spark, folder), [1, 7, 42, 120])
    return df.select("question_id", "o_orderkey", "run_index")


def runs_overview(spark, folder):
    return _rounded(runs.overview(_runs(spark, folder)))


def decision_dist(spark, folder):
    return runs.decision_distribution(_runs(spark, folder))


def step_status(spark, folder):
    return runs.status_distribution(_steps(spark, folder))


def step_errors(spark, folder):
    return runs.error_distribution(_steps(spark, folder))


def step_error_shares(spark, folder):
    return _rounded(stats.share_of_total(runs.error_distribution(_steps(spark, folder))), 6)


def rounds_hist(spark, folder):
    return runs.rounds_histogram(_runs(spark, folder))


def failed_step_errors(spark, folder):
    return runs.failed_step_errors(_steps(spark, folder))


def errors_by_question(spark, folder):
    return runs.errors_by_question(_runs(spark, folder))


def null_answers(spark, folder):
    return runs.null_answer_errors(_runs(spark, folder))


def run_times(spark, folder):
    return _rounded(runs.time_statistics(_runs(spark, folder)), 6)


def run_time_hist(spark, folder):
    return _rounded(runs.time_histogram(_runs(spark, folder)))


def _with_metadata(spark, folder):
    return runs.with_metadata(_runs(spark, folder), _questions(spark, folder))


def runs_with_metadata(spark, folder):
    return _with_metadata(spark, folder).select(
        "question_id", "o_orderkey", "run_index", *runs.DIMENSIONS)


def by_dimension(spark, folder):
    return _rounded(runs.by_dimension(_with_metadata(spark, folder)), 6)


def errors_by_dimension(spark, folder):
    return runs.errors_by_dimension(_with_metadata(spark, folder))


def consistency(spark, folder):
    return _rounded(runs.consistency(_runs(spark, folder)))


def consistency_by_question(spark, folder):
    return runs.consistency_by_question(_runs(spark, folder))


def consistency_detail(spark, folder):
    df = _runs(spark, folder).withColumn("question_id", F.concat_ws("/", "question_id", "o_orderkey"))
    return runs.consistency_detail(df)


def status_success(spark, folder):
    df = runs.status_success(_runs(spark, folder))
    by = runs.status_success(_runs(spark, folder), ["source_dir"])
    return _rounded(df.withColumn("source_dir", F.lit("all")).unionByName(by))


def top_errors(spark, folder):
    return runs.top_errors(_runs(spark, folder), 2)


def compare_sources(spark, folder):
    sources = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    df = _rounded(runs.compare_sources(_runs(spark, folder), sources))
    return df.toDF("measure", *[f"s{i + 1}" for i in range(5)])


def repeated_plans(spark, folder):
    steps = _steps(spark, folder).withColumn("question_id", F.concat_ws("/", "question_id", "o_orderkey"))
    return runs.repeated_plans(steps)


def stubborn_plans(spark, folder):
    """Failed plans per question over all of its runs."""
    steps = _steps(spark, folder).withColumn("run_index", F.lit(0))
    return runs.stubborn_plans(steps)


def timeout_streaks(spark, folder):
    """Errors in a row per user, in the order of events."""
    df = runs.timeout_streaks(read(spark, folder, "events"), ["user_id"], ["ts", "event_id"],
                              F.when(col("event_type") == "error", 1).otherwise(0))
    return df.select("user_id", "event_id", "streak", "stopped")


def timeout_streaks_session(spark, folder):
    """One session over all events; an error counts as many timeouts as its value has tens."""
    df = runs.timeout_streaks(
        read(spark, folder, "events"), [], ["ts", "event_id"],
        F.when(col("event_type").isin("error", "view", "click"), F.floor(col("value") / 10)).otherwise(0))
    return df.select("event_id", "streak", "stopped")


_LOG = "record STRING, o_orderkey BIGINT, runs ARRAY<STRUCT<" + readers.schemas.RUN + ">>"


def _logs(spark, folder):
    """One log per question, packed and stored once per session."""
    key = (spark.sparkContext.applicationId, folder, "logs")
    if key not in _STORED:
        path = scratch_path(spark, "logs")
        records = _records(spark, folder).withColumn("record", col("question_id"))
        sinks.write_question_logs(records.drop("source_dir"), path)
        _STORED[key] = path
    return _STORED[key]


def question_log(spark, folder):
    """One log per question, read back as JSON lines and flattened."""
    flat = runs.flatten(readers.log_lines(readers.packed_logs(spark, _logs(spark, folder)), _LOG))
    return flat.groupBy("record").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("rounds").alias("rounds"))


def result_logs(spark, folder):
    """The logs of all questions scanned file by file: runs by decision, and where each log lies."""
    logs = readers.result_logs(readers.packed_logs(spark, _logs(spark, folder)), _LOG)
    flat = runs.flatten(logs)
    return flat.groupBy("record", F.substring_index("source_dir", "=", -1).alias("question")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if("decision").alias("n_true"),
        F.count_if(col("decision").isNull()).alias("n_null"), F.sum("failed_steps").alias("failed"))


def run_log_stream(spark, folder):
    """A log followed as a stream: two appends, each read once."""
    log, out, progress = (scratch_path(spark, n) for n in ("log", "runs", "progress"))
    records = _records(spark, folder)
    for part in ("source_dir < '3'", "source_dir >= '3'"):
        sinks.append_records(records.filter(part).withColumn("golden_answer", col("source_dir")), log)
        run_logs.follow(spark, log, out, progress).awaitTermination()
    df = spark.read.parquet(out)
    return df.groupBy(col("golden_answer").alias("source_dir"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("failed_steps").alias("failed"))


# Gold answers and model answers from part, in several spellings.
_GOLD = """case when p_size < 10 then 'Yes' when p_size < 20 then concat(p_name, ', ', p_type)
  when p_size < 30 then cast(p_size as varchar(9)) when p_size < 40 then p_brand else 'three' end"""
_GIVEN = """case when p_size < 5 then ' true. ' when p_size < 10 then 'no'
  when p_size < 20 then concat('  ', upper(p_type), ' ,', p_name, ',', p_type, '!')
  when p_size < 30 then concat(cast(p_size as varchar(9)), '.0') when p_size < 35 then upper(p_brand)
  when p_size < 40 then cast(null as varchar(9)) when p_size < 45 then '3' else 'four' end"""


def answers_match(spark, folder):
    df = read(spark, folder, "part").select(
        "p_partkey", F.expr(_GOLD).alias("gold"), F.expr(_GIVEN).alias("given"))
    return df.select("p_partkey", answer.answers_match(col("gold"), col("given")).alias("same"))


def answers_numeric_tol(spark, folder):
    df = read(spark, folder, "orders").select(
        "o_orderkey", col("o_totalprice").cast("string").alias("gold"),
        F.when(col("o_orderstatus") == "P", "unknown").otherwise(
            F.round("o_totalprice", 1).cast("string")).alias("given"))
    return df.select("o_orderkey", answer.numbers_match(col("gold"), col("given"), 0.03).alias("same"))


def single_cell_answer(spark, folder):
    """Customers with exactly one finished order above 300000 have a single answer."""
    df = read(spark, folder, "orders").filter("o_orderstatus = 'F' and o_totalprice > 300000")
    return answers.single_cell_answers(
        df.withColumn("priority", col("o_orderpriority")), ["o_custkey"], ["priority"])


def _result_cells(spark, folder, status):
    df = read(spark, folder, "orders").filter(col("o_orderstatus") == status).select(
        "o_custkey", "o_orderpriority", F.expr("nullif(o_orderstatus, 'F')").alias("o_orderstatus"),
        (col("o_orderkey") % 3).alias("third"))
    return answers.result_values(df, ["o_custkey"], ["o_orderpriority", "o_orderstatus", "third"])


def result_values(spark, folder):
    """Distinct cells of each customer's rows; zeros and missing cells do not count."""
    return _result_cells(spark, folder, "O")


def result_as_list(spark, folder):
    return answers.list_answers(_result_cells(spark, folder, "O"), ["o_custkey"])


def result_chunks(spark, folder):
    """The same lists in chunks of two values."""
    chunks = answers.answer_chunks(_result_cells(spark, folder, "O"), ["o_custkey"], 2)
    return chunks.drop("digest")


def result_long_lists_equal(spark, folder):
    """Lists compared by the digests of their chunks."""
    chunks = lambda status: answers.answer_chunks(read(spark, folder, "orders").filter(col("o_orderstatus") == status).select(
        "o_custkey", col("o_orderpriority").alias("value")).distinct(), ["o_custkey"], 2)
    return answers.same_long_lists(chunks("O"), chunks("P"), ["o_custkey"])


def result_lists_equal(spark, folder):
    cells = lambda status: read(spark, folder, "orders").filter(col("o_orderstatus") == status).select(
        "o_custkey", col("o_orderpriority").alias("value")).distinct()
    return answers.same_lists(cells("O"), cells("P"), ["o_custkey"])


# Responses: the text of a turn in one of several block forms.
_FORM = "(conv_id + turn) % 8"
_RESPONSE = f"""case {_FORM}
  when 0 then concat('PLAN\\n', text, '\\nEND PLAN')
  when 1 then concat('**PLAN**\\n', text, '\\n**END**')
  when 2 then concat('Some words.\\n**END**\\n', text)
  when 3 then concat('END\\n', text, '\\nEND')
  when 4 then concat('PLAN\\nload a\\nEND PLAN\\nthen\\nPLAN\\n', text, '\\nEND PLAN')
  when 5 then concat('PLAN\\nselect b\\nEND PLAN\\nEND\\n', text, '\\nEND')
  when 6 then concat('## END\\n', text)
  else text end"""


def _responses(spark, folder):
    return read(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.expr(_RESPONSE).alias("response"))


def response_blocks(spark, folder):
    """Kind and content of every response, before and after the plan was run."""
    df = _responses(spark, folder)
    first, later = answer.classify_response(col("response")), answer.classify_response(col("response"), True)
    return df.select("conv_id", "turn", answer.block_kinds(col("response")).alias("blocks"),
                     first["kind"].alias("kind"), first["content"].alias("content"),
                     later["kind"].alias("kind_later"), later["content"].alias("content_later"))


def single_blocks(spark, folder):
    """Responses that must hold exactly one block."""
    block = answer.single_block(col("response"))
    return _responses(spark, folder).select("conv_id", "turn", block["kind"].alias("kind"), block["content"].alias("content"))


QUERIES = {f.__name__: f for f in [
    runs_flatten, final_status, runs_of_questions, runs_overview, decision_dist, step_status,
    step_errors, step_error_shares, rounds_hist, failed_step_errors, errors_by_question,
    null_answers, run_times, run_time_hist, runs_with_metadata, by_dimension, errors_by_dimension,
    consistency, consistency_by_question, consistency_detail, status_success, top_errors,
    compare_sources, repeated_plans, stubborn_plans, timeout_streaks, timeout_streaks_session,
    question_log, run_log_stream, answers_match, answers_numeric_tol, single_cell_answer,
    result_values, result_as_list, result_chunks, result_lists_equal, result_long_lists_equal, response_blocks,
    single_blocks, result_logs,
]}

_STEPS = f"""(select printf('question_%03d', o_custkey) as question_id, o_orderkey, o_orderpriority as source_dir,
  r.i as run_index, s.j as step_index, {_CONTENT.format(i='r.i', j='s.j')} as content,
  {_STATUS.format(i='r.i', j='s.j')} as status, {_CODE.format(i='r.i', j='s.j')} as error
  from orders, range(0, 3) r(i), range(0, 5) s(j)
  where r.i < 1 + o_orderkey % 3 and s.j < (o_orderkey + r.i) % 6)"""
_RUNS = f"""(with st as (select o_orderkey, run_index, arg_max(status, step_index) as status,
    arg_max([error], step_index)[1] as error_code,
    count(*) filter (content <> '' and content not like 'System:%') as rounds,
    count(*) filter (status = 'FAILED') as failed_steps from {_STEPS} group by 1, 2)
  select printf('question_%03d', o_custkey) as question_id, o.o_orderkey, o_orderpriority as source_dir,
    cast(r.i as int) as run_index, cast(1 + o.o_orderkey % 3 as int) as total_runs,
    {_ANSWER.replace("o_orderkey", "o.o_orderkey").format(i='r.i')} as llm_answer,
    {_DECISION.replace("o_orderkey", "o.o_orderkey").format(i='r.i')} as decision,
    o_totalprice / 1000 + r.i as time_s, {_ERROR.replace("o_orderkey", "o.o_orderkey").format(i='r.i')} as error,
    st.status, st.error_code, cast(coalesce(rounds, 0) as int) as rounds,
    cast(coalesce(failed_steps, 0) as int) as failed_steps
  from orders o join range(0, 3) r(i) on r.i < 1 + o.o_orderkey % 3
  left join st on st.o_orderkey = o.o_orderkey and st.run_index = r.i)"""
_LABEL = "case when decision then 'SUCCESS' when not decision then 'FAILED' else 'NULL_ANSWER' end"
_META = """(select printf('question_%03d', c_custkey) as question_id, c_mktsegment as reasoning_type,
  c_acctbal > 0 as answerable, 'numerical' as answer_type, nullif(c_mktsegment, 'BUILDING') as distractor_type,
  c_nationkey > 12 as has_distractor, cast(c_nationkey % 3 + 1 as int) as table_number,
  cast(c_nationkey as varchar) as domain, case when c_acctbal / 300 <= 6.0 then 'low'
  when c_acctbal / 300 <= 21.5 then 'medium' else 'high' end as complexity
  from customer where c_mktsegment <> 'FURNITURE')"""
_JOINED = f"(select r.*, m.* exclude (question_id) from {_RUNS} r left join {_META} m on r.question_id = m.question_id)"
_RATE = "avg(case when decision then 1.0 else 0.0 end)"


def _long(columns):
    return "(" + " union all ".join(
        f"select '{d}' as dimension, cast({d} as varchar) as value, {columns} from {_JOINED} where {d} is not null"
        for d in runs.DIMENSIONS) + ")"


def _consistent(key):
    return f"""(select {key} as question_id, count(*) as runs,
      count(distinct coalesce(cast(decision as varchar), 'null')) = 1 as consistent,
      count(*) filter (decision) as n_true, count(*) filter (not decision) as n_false,
      case when count(*) filter (decision) = count(*) then 'all_success'
        when count(*) filter (not decision) = count(*) then 'all_error'
        when count(*) filter (decision is null) = count(*) then 'all_null' else 'mixed' end as kind
      from {_RUNS} group by 1 having count(*) > 1)"""


_KINDS = ["all_success", "all_error", "all_null", "mixed"]
_SOURCES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _pick(measure, expr):
    return f"select '{measure}' as measure, " + ", ".join(
        f"round({expr} filter (source_dir = '{s}'), 4) as s{i + 1}" for i, s in enumerate(_SOURCES)
    ) + f" from {_RUNS}"


_RUN_ITEM = """coalesce(case regexp_replace(lower(trim({x})), '[.!?]+$', '') when 'yes' then 'true'
  when 'no' then 'false' when 'three' then '3.0' when 'four' then '4.0' end,
  cast(try_cast(regexp_replace(lower(trim({x})), '[.!?]+$', '') as double) as varchar),
  trim(regexp_replace(lower(trim({x})), '[.!?]+$', '')))"""
_KEY = ("list_sort(list_distinct(list_transform(string_split(regexp_replace(trim({t}), '[.!?]+$', ''), ','), lambda x: "
        + _RUN_ITEM.format(x="x") + ")))")
_GOLD_SQL, _GIVEN_SQL = _GOLD, _GIVEN
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_TEXT = _STRIP.format(x="text")

SQL = {
    "runs_flatten": f"""select question_id, o_orderkey, run_index, total_runs, llm_answer, decision,
        round(time_s, 6) as time_s, error, status, error_code, rounds, failed_steps, {_LABEL} as label from {_RUNS}""",
    "final_status": f"""select 'status' as dimension, status as value, count(*) as count from {_RUNS}
        where status is not null group by 2
        union all select 'error_code', error_code, count(*) from {_RUNS} where error_code is not null group by 2""",
    "runs_of_questions": f"""select question_id, o_orderkey, run_index from {_RUNS}
        where question_id in ('question_001', 'question_007', 'question_042', 'question_120')""",
    "runs_overview": f"""select count(*) as total_runs, count(distinct question_id) as unique_questions,
        round({_RATE}, 4) as success_rate, cast(sum(rounds) as bigint) as total_rounds,
        round(avg(rounds), 4) as mean_rounds, cast(sum(failed_steps) as bigint) as total_failed_steps,
        round(avg(failed_steps), 4) as mean_failed_steps,
        count(*) filter (llm_answer is null) as null_answers from {_RUNS}""",
    "decision_dist": f"select {_LABEL} as label, count(*) as count from {_RUNS} group by 1",
    "step_status": f"select status, count(*) as count from {_STEPS} group by 1",
    "step_errors": f"""select case when status = 'SUCCESS' then 'SUCCESS' else error end as code,
        count(*) as count from {_STEPS} where status = 'SUCCESS' or error is not null group by 1""",
    "step_error_shares": f"""with c as (select case when status = 'SUCCESS' then 'SUCCESS' else error end as code,
          count(*) as count from {_STEPS} where status = 'SUCCESS' or error is not null group by 1),
        t as (select sum(count) as n from c)
        select code, count, round(count / n, 6) as share,
          case when count / n < 0.01 then 'minor' else 'main' end as share_class from c, t""",
    "rounds_hist": f"select rounds, count(*) as runs from {_RUNS} group by 1",
    "failed_step_errors": f"""select coalesce(error, 'UNKNOWN') as error, count(*) as count from {_STEPS}
        where status = 'FAILED' group by 1""",
    "errors_by_question": f"select question_id, cast(sum(failed_steps) as bigint) as errors from {_RUNS} group by 1",
    "null_answers": f"""select coalesce(error, 'no_error_field') as error, count(*) as count from {_RUNS}
        where llm_answer is null group by 1""",
    "run_times": f"""select 'time' as "column", count(time_s) as count, round(avg(time_s), 6) as mean,
        round(median(time_s), 6) as median, round(stddev_samp(time_s), 6) as std, round(min(time_s), 6) as min,
        round(max(time_s), 6) as max from {_RUNS}""",
    "run_time_hist": f"""with v as (select time_s as v from {_RUNS}),
        b as (select min(v) as lo, max(v) as hi, greatest(10, least(30, count(*) // 2)) as n from v),
        c as (select least(cast(floor((v - lo) / ((hi - lo) / n)) as int), cast(n as int) - 1) as bin,
          count(*) as count from v, b group by 1)
        select cast(g.bin as int) as bin, round(lo + (hi - lo) / n * g.bin, 4) as low,
          round(lo + (hi - lo) / n * (g.bin + 1), 4) as high, coalesce(c.count, 0) as count
        from b, range(0, 30) g(bin) left join c on c.bin = g.bin where g.bin < n""",
    "runs_with_metadata": f"select question_id, o_orderkey, run_index, {', '.join(runs.DIMENSIONS)} from {_JOINED}",
    "by_dimension": f"""select dimension, value, count(*) as count, round({_RATE}, 6) as success_rate,
        round(avg(cast(time_s as decimal(18,6))), 6) as mean_time, round(median(time_s), 6) as median_time,
        round(stddev_samp(time_s), 6) as std_time, round(min(time_s), 6) as min_time,
        round(max(time_s), 6) as max_time from {_long('time_s, decision')} group by 1, 2""",
    "errors_by_dimension": f"""select dimension, value, error_code, count(*) as count
        from {_long('error_code')} where error_code is not null group by 1, 2, 3""",
    "consistency": "select count(*) as questions, count(*) filter (consistent) as consistent, "
        + ", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in _KINDS)
        + ", round(count(*) filter (consistent) / count(*), 4) as consistent_rate, "
        + ", ".join(f"round(count(*) filter (kind = '{k}') / count(*), 4) as {k}_rate" for k in _KINDS)
        + f" from {_consistent('question_id')}",
    "consistency_by_question": f"select * from {_consistent('question_id')}",
    "consistency_detail": f"""select r.question_id || '/' || o_orderkey as question_id, run_index, decision,
        status, error_code, runs, consistent, kind from {_RUNS} r
        join {_consistent("question_id || '/' || o_orderkey")} c
        on c.question_id = r.question_id || '/' || r.o_orderkey""",
    "status_success": f"""select 'all' as source_dir, count(*) as count,
          round(avg(case when status = 'SUCCESS' then 1.0 else 0.0 end), 4) as success_rate
          from {_RUNS}
        union all select source_dir, count(*), round(avg(case when status = 'SUCCESS' then 1.0 else 0.0 end), 4)
          from {_RUNS} group by 1""",
    "top_errors": f"""select error_code, count(*) as count from {_RUNS} where error_code is not null
        group by 1 order by 2 desc, 1 limit 2""",
    "compare_sources": " union all ".join([
        _pick("runs", "cast(count(*) as double)").replace("cast(count(*) as double) filter", "count(*) filter")
            .replace("round(count(*)", "round(1.0::double * count(*)"),
        _pick("success_rate", _RATE), _pick("mean_rounds", "avg(rounds)"),
        _pick("mean_failed_steps", "avg(failed_steps)"), _pick("mean_time", "avg(time_s)")]),
    "repeated_plans": f"""select question_id || '/' || o_orderkey as question_id, cast(run_index as int) as run_index,
        content, count(*) as times from {_STEPS} group by 1, 2, 3 having count(*) >= 3""",
    "stubborn_plans": f"""select question_id, 0 as run_index, content, count(*) as failures, count(*) >= 5 as stopped
        from {_STEPS} where status = 'FAILED' group by 1, 3 having count(*) >= 3""",
    "timeout_streaks": """with g as (select user_id, event_id, ts, event_type = 'error' as hit,
          sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) as island
          from events),
        s as (select user_id, event_id, cast(sum(case when hit then 1 else 0 end)
          over (partition by user_id, island order by ts, event_id) as bigint) as streak from g)
        select user_id, event_id, streak, streak >= 3 as stopped from s""",
    "timeout_streaks_session": """with w as (select event_id, ts, case when event_type in ('error', 'view', 'click')
          then cast(floor(value / 10) as bigint) else 0 end as w from events),
        g as (select *, sum(case when w = 0 then 1 else 0 end) over (order by ts, event_id) as island from w),
        s as (select event_id, cast(sum(w) over (partition by island order by ts, event_id) as bigint) as streak from g)
        select event_id, streak, streak >= 3 as stopped from s""",
    "question_log": f"""select question_id as record, count(*) as n_runs, cast(sum(rounds) as bigint) as rounds
        from {_RUNS} group by 1""",
    "result_logs": f"""select question_id as record, question_id as question, count(*) as n_runs,
        count(*) filter (decision) as n_true, count(*) filter (decision is null) as n_null,
        cast(sum(failed_steps) as bigint) as failed from {_RUNS} group by 1, 2""",
    "run_log_stream": f"""select source_dir, {_LABEL} as label, count(*) as n, cast(sum(failed_steps) as bigint) as failed
        from {_RUNS} group by 1, 2""",
    "answers_match": f"""with a as (select p_partkey, {_GOLD_SQL} as gold, {_GIVEN_SQL} as given from part)
        select p_partkey, coalesce({_KEY.format(t='gold')} = {_KEY.format(t='given')}, false) as same from a""",
    "answers_numeric_tol": """select o_orderkey, o_orderstatus <> 'P'
        and abs(o_totalprice - round(o_totalprice, 1)) <= 0.03 as same from orders""",
    "single_cell_answer": """select o_custkey, case when count(*) = 1 then min(o_orderpriority) end as answer
        from orders where o_orderstatus = 'F' and o_totalprice > 300000 group by 1""",
    "result_values": """select distinct o_custkey, v.value from orders, unnest([o_orderpriority, o_orderstatus,
        case when o_orderkey % 3 <> 0 then cast(o_orderkey % 3 as varchar) end]) v(value)
        where o_orderstatus = 'O' and v.value is not null""",
    "result_as_list": """with d as (select distinct o_custkey, v.value from orders, unnest([o_orderpriority,
        o_orderstatus, case when o_orderkey % 3 <> 0 then cast(o_orderkey % 3 as varchar) end]) v(value)
        where o_orderstatus = 'O' and v.value is not null)
        select o_custkey, count(*) as n_values, string_agg(value, ', ' order by value) as answer from d group by 1""",
    "result_chunks": """with d as (select distinct o_custkey, v.value from orders, unnest([o_orderpriority,
        o_orderstatus, case when o_orderkey % 3 <> 0 then cast(o_orderkey % 3 as varchar) end]) v(value)
        where o_orderstatus = 'O' and v.value is not null),
        n as (select *, (row_number() over (partition by o_custkey order by value) - 1) // 2 as chunk from d)
        select o_custkey, chunk, count(*) as n_values, string_agg(value, ', ' order by value) as answer from n group by 1, 2""",
    "single_blocks": f"""with r as (select conv_id, turn, {_FORM} as form, {_TEXT} as t from conversations)
        select conv_id, turn, case when form in (0, 1) then 'PLAN' when form = 3 then 'END' else 'ERROR' end as kind,
          case when form in (0, 1, 3) then t when form in (4, 5) then 'FORMAT_MULTIPLE_BLOCKS'
            else 'FORMAT_NO_BLOCK' end as content from r""",
    "result_lists_equal": """with o as (select distinct o_custkey, o_orderpriority as v from orders where o_orderstatus = 'O'),
        p as (select distinct o_custkey, o_orderpriority as v from orders where o_orderstatus = 'P'),
        j as (select coalesce(o.o_custkey, p.o_custkey) as o_custkey, o.v as a, p.v as b
          from o full join p on o.o_custkey = p.o_custkey and o.v = p.v)
        select o_custkey, bool_and(a is not null and b is not null) as same, count(a) as n_left,
          count(b) as n_right from j group by 1""",
    "response_blocks": f"""with r as (select conv_id, turn, {_FORM} as form, {_TEXT} as t from conversations)
        select conv_id, turn,
          case when form in (0, 1, 4) then 'PLAN' when form in (2, 3, 6) then 'END' when form = 5 then 'both'
            else 'none' end as blocks,
          case when form in (0, 1, 4, 5) then 'PLAN' when form in (2, 3, 6) then 'END' else 'ERROR' end as kind,
          case when form in (0, 1, 2, 3, 6) then t when form = 4 then 'load a' || chr(10) || t
            when form = 5 then 'select b' else 'FORMAT_NO_BLOCK' end as content,
          case when form in (0, 1, 4) then 'PLAN' when form in (2, 3, 5, 6) then 'END' else 'ERROR' end as kind_later,
          case when form in (0, 1, 2, 3, 5, 6) then t when form = 4 then 'load a' || chr(10) || t
            else 'FORMAT_NO_BLOCK' end as content_later from r""",
}

SQL["result_long_lists_equal"] = SQL["result_lists_equal"]
