"""Question sets, previews and question statistics.

Documents stand in for questions: text = question, lang = domain, source = reasoning type, labels
say whether it is answerable.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import corpus, read
from tableworks.functions.columns import col
from tableworks.operators import stats
from tableworks.plans import preview, questions

# Question fields as expressions both engines understand, over documents d and labels l.
_N = "n_chars"
_FIELDS = {
    "question_id": "concat('question_', case when doc_id < 10 then '00' when doc_id < 100 then '0' else '' end, cast(doc_id as varchar(20)))",
    "question": "text",
    "answer_type": "case when quality is null then 'NA' when quality = 1 then 'numerical' when toxic = 1 then 'boolean' else 'free' end",
    "domain": "lang",
    "reasoning_type": "source",
    "subset": "case when toxic = 1 then 'distractor_bank' when quality = 1 then 'single_table' when quality = 0 then 'multi_table' else 'single_table' end",
    "answerable": "case when quality is null then cast(null as boolean) else quality = 1 end",
    "n_tables": "case when quality = 0 then 1 + doc_id % 3 else 1 end",
    "n_steps": "doc_id % 7",
    "n_rows": "n_chars % 97",
    "n_columns": "doc_id % 11",
    "table_number": "case when quality = 0 then 1 + doc_id % 3 when toxic = 1 then 5 else 1 end",
    "requires_calculation": "n_chars > 500",
    "distractor_type": "case when toxic = 1 then 'misleading' when quality = 1 then 'none' end",
}
_SCORE = ("(n_chars % 97) * 0.1 + (doc_id % 11) * 0.2 + (doc_id % 7) * 0.5"
          " + case when quality = 0 and toxic = 1 then 1 else 0 end")


def _flat(spark, folder):
    docs = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id", "left")
    return docs.select("doc_id", *[F.expr(e).alias(n) for n, e in _FIELDS.items()],
                       F.expr(_SCORE).cast("double").alias("score"))


def _records(spark, folder):
    """Question records in their stored form."""
    names = lambda prefix, n: F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i <= n),
        lambda i: F.concat(F.lit(prefix), i.cast("string")))
    flat = _flat(spark, folder)
    return flat.select(
        col("doc_id").alias("number"), "question_id", "question", "answer_type", "domain",
        "reasoning_type", "subset", "answerable", "requires_calculation", "distractor_type",
        names("table_000", col("n_tables")).alias("table_refs"),
        names("step ", col("n_steps")).alias("reasoning_steps"),
        col("table_number").cast("int").alias("table_number"),
        F.lit(None).cast("boolean").alias("has_distractor"),
        F.struct(col("n_rows").cast("int").alias("rows_involved"),
                 col("n_columns").cast("int").alias("columns_involved"),
                 col("n_steps").cast("int").alias("steps_count"),
                 col("score").alias("complexity_score")).alias("complexity_metrics"),
    )


def select_subset(spark, folder):
    records = _records(spark, folder)
    return questions.select_subset(records, "multi_table").select(F.lit("multi_table").alias("mode"), "question_id") \
        .union(questions.select_subset(records, "distractor").select(F.lit("distractor"), "question_id")) \
        .union(questions.select_subset(records, "all").select(F.lit("all"), "question_id"))


# id lists made from orders: single ids, ranges, reversed ranges, bad tokens, repeats
_SPEC = """concat(cast(o_orderkey as varchar(20)), ',', cast(o_orderkey + 5 as varchar(20)), '-',
  cast(o_orderkey + 1 as varchar(20)), ', x, 7-a,', cast(o_orderkey + 4 as varchar(20)), '-',
  cast(o_orderkey + 8 as varchar(20)))"""


def expand_ids(spark, folder):
    """One id list per customer, one specification per order."""
    specs = read(spark, folder, "orders").select("o_custkey", "o_orderkey", F.expr(_SPEC).alias("spec"))
    return questions.expand_ids(specs, "o_custkey", "spec", "o_orderkey")


def custom_ids(spark, folder):
    """Listed ids that exist as questions; with several subsets the first one counts."""
    specs = read(spark, folder, "orders").select(
        F.lit("list").alias("list"), "o_orderkey",
        F.concat(col("o_orderkey").cast("string"), F.lit("-"), (col("o_orderkey") + 3).cast("string")).alias("spec"))
    ids = questions.expand_ids(specs, "list", "spec", "o_orderkey")
    records = _records(spark, folder).select("number", "question_id", "subset")
    again = records.withColumn("subset", F.lit("multi_table"))
    picked = questions.pick_custom(ids, records.union(again))
    return picked.select("rank", "id", "question_id", "subset")


def capped_questions(spark, folder):
    return questions.cap(_records(spark, folder).select("number", "question_id"), ["number"], 50)


def shuffled_questions(spark, folder):
    """The question list in seeded order, cut into batches of 16."""
    keyed = questions.shuffled(_records(spark, folder).select("number"), ["number"], 42)
    return questions.batches(keyed, ["shuffle_key", "number"], 16).drop("shuffle_key")


def batches(spark, folder):
    df = questions.batches(read(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 50)
    return df


def resume_from(spark, folder):
    """Orders by date and key from one order on."""
    orders = read(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    return questions.resume_from(orders, ["o_orderdate", "o_orderkey"], "o_orderkey", 77).select("o_orderkey")


def complexity_tier(spark, folder):
    df = read(spark, folder, "documents").select(
        "doc_id", (col("n_chars") % 97).alias("r"), (col("doc_id") % 11).alias("c"), (col("doc_id") % 7).alias("s"))
    score = questions.complexity_score(col("r"), col("c"), col("s"))
    return df.select("doc_id", F.round(score, 4).alias("score"), questions.complexity_tier(score).alias("tier"))


def question_features(spark, folder):
    df = questions.features(_records(spark, folder))
    return df.drop("question").withColumn("complexity_score", F.round("complexity_score", 4))


def question_violations(spark, folder):
    return questions.violations(_records(spark, folder))


def question_distributions(spark, folder):
    return questions.question_distributions(questions.features(_records(spark, folder)))


def _rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else col(c) for c, t in df.dtypes])


def question_report(spark, folder):
    return _rounded(questions.question_report(questions.features(_records(spark, folder))))


def distractor_report(spark, folder):
    return _rounded(questions.distractor_report(questions.features(_records(spark, folder))))


def domain_by_reasoning(spark, folder):
    flat = questions.features(_records(spark, folder))
    langs = ["de", "en", "es", "fr"]
    return stats.crosstab(flat, "reasoning_type", "domain", langs)


def complexity_by_answer_type(spark, folder):
    df = stats.boxplot(questions.features(_records(spark, folder)), ["answer_type"], "complexity_score")
    return _rounded(df)


def _previews(spark, folder, mode):
    return preview.table_previews(
        corpus.rows(spark, folder), corpus.headers(spark), corpus.titles(spark), mode)


def table_previews(spark, folder):
    """Five rows, stats, description and structure of every table."""
    df = _previews(spark, folder, "header_5")
    first = F.get_json_object(F.substring_index("sample_rows", "\n", 1), "$.Entity")
    return df.select("table_id", "row_count", "stats", "description", first.alias("first_entity"),
                     F.size(F.split("sample_rows", "\n")).alias("shown"))


def preview_texts(spark, folder):
    """The whole texts of the previews: five rows as JSON, and the structure of the columns."""
    return _previews(spark, folder, "header_5").select("table_id", "sample_rows", "structure")


def table_previews_full(spark, folder):
    df = _previews(spark, folder, "full_table")
    return df.select("table_id", F.size(F.split("sample_rows", "\n")).alias("shown"))


def question_previews(spark, folder):
    """Every question with its tables; table_0003 is taken out and shows its marker."""
    shown = _previews(spark, folder, "header_1").filter("table_id <> 'table_0003'")
    df = preview.question_previews(_records(spark, folder), shown)
    return df.select("question_id", "at", "table_id", "stats", "description")


QUERIES = {f.__name__: f for f in [
    select_subset, expand_ids, custom_ids, capped_questions, shuffled_questions, batches,
    resume_from, complexity_tier, question_features, question_violations, question_distributions,
    question_report, distractor_report, domain_by_reasoning, complexity_by_answer_type,
    table_previews, preview_texts, table_previews_full, question_previews,
]}

_Q = ("(select doc_id, " + ", ".join(f'{e} as {n}' for n, e in _FIELDS.items())
      + f", cast({_SCORE} as double) as score from documents d left join labels l using (doc_id))")
_TIERS = "case when score <= 6.0 then 'low' when score <= 21.5 then 'medium' else 'high' end"
_FEATURES = f"""(select question_id, answer_type, domain, reasoning_type, subset,
  coalesce(answerable, true) as answerable, cast(n_rows as int) as rows_involved,
  cast(n_columns as int) as columns_involved, cast(n_steps as int) as steps_count,
  score as complexity_score, cast(table_number as int) as table_number,
  requires_calculation, false as has_distractor, coalesce(distractor_type, 'none') as distractor_type,
  cast(length(question) as int) as question_length, cast(n_steps as int) as reasoning_steps_count,
  {_TIERS} as complexity_level, table_number = 1 as is_single_table, table_number > 1 as is_multi_table
  from {_Q})"""
_FLAGS = ["is_single_table", "is_multi_table", "answerable", "requires_calculation"]
_MEASURES = ["complexity_score", "question_length", "reasoning_steps_count", "table_number",
             "rows_involved", "columns_involved", "steps_count"]

SQL = {
    "select_subset": f"""select 'multi_table' as mode, question_id from {_Q} where subset = 'multi_table'
        union all select 'distractor', question_id from {_Q} where subset = 'distractor_bank'
        union all select 'all', question_id from {_Q}""",
    "expand_ids": """with ids as (
          select o_custkey, o_orderkey, 0 as t, 0 as i, o_orderkey as id from orders
          union all select o_custkey, o_orderkey, 1, r.i, o_orderkey + 1 + r.i from orders, range(0, 5) r(i)
          union all select o_custkey, o_orderkey, 4, r.i, o_orderkey + 4 + r.i from orders, range(0, 5) r(i)),
        f as (select o_custkey, id, min([o_orderkey, t, i]) as first from ids group by 1, 2)
        select o_custkey, id, row_number() over (partition by o_custkey order by first, id) as rank from f""",
    "custom_ids": f"""with ids as (select o_orderkey, r.i, o_orderkey + r.i as id from orders, range(0, 4) r(i)),
        f as (select id, min([o_orderkey, i]) as first from ids group by 1),
        n as (select id, row_number() over (order by first, id) as rank from f)
        select rank, id, question_id,
          case when subset = 'distractor_bank' then 'multi_table' else subset end as subset
        from n join {_Q} q on q.doc_id = n.id""",
    "capped_questions": f"select doc_id as number, question_id from {_Q} order by doc_id limit 50",
    "shuffled_questions": """with n as (select doc_id as number,
          row_number() over (order by md5('42:' || doc_id), doc_id) as position from documents)
        select number, position, (position - 1) // 16 + 1 as batch, (position - 1) % 16 + 1 as batch_position from n""",
    "batches": """with n as (select o_orderkey, row_number() over (order by o_orderkey) as position from orders)
        select o_orderkey, position, (position - 1) // 50 + 1 as batch, (position - 1) % 50 + 1 as batch_position from n""",
    "resume_from": """select o_orderkey from orders where (o_orderdate, o_orderkey) >=
        (select (o_orderdate, o_orderkey) from orders where o_orderkey = 77)""",
    "complexity_tier": """with s as (select doc_id, (n_chars % 97) * 0.1::double + (doc_id % 11) * 0.2::double
          + (doc_id % 7) * 0.5::double as score from documents)
        select doc_id, round(score, 4) as score, case when score <= 6.0 then 'low'
          when score <= 21.5 then 'medium' else 'high' end as tier from s""",
    "question_features": f"select * replace (round(complexity_score, 4) as complexity_score) from {_FEATURES}",
    "question_violations": f"""with r as (select *, [case when coalesce(answerable, null) is null then 'missing_field' end,
          case when answer_type = 'free' then 'answer_type' end,
          case when answerable = (answer_type = 'NA') then 'answerable' end,
          case when table_number <> n_tables then 'table_number' end,
          case when abs(score - (n_rows * 0.1 + n_columns * 0.2 + n_steps * 0.5)) > 0.05 then 'complexity_score' end]
          as rules from {_Q})
        select question_id, rule from r, unnest(rules) u(rule) where rule is not null""",
    "question_distributions": " union all ".join(
        f"""select '{d}' as dimension, cast({d} as varchar) as value, count(*) as count from {_FEATURES}
          where {d} is not null group by 2""" for d in questions.DISTRIBUTIONS),
    "question_report": "select count(*) as total_questions, "
        + ", ".join(f"count(*) filter ({f}) as n_{f}" for f in _FLAGS) + ", "
        + ", ".join(f"round(avg(cast({f} as int)), 4) as share_{f}" for f in _FLAGS) + ", "
        + ", ".join(f"round(avg({m}), 4) as mean_{m}" for m in _MEASURES) + ", "
        + ", ".join(f"round(stddev_samp({m}), 4) as std_{m}" for m in _MEASURES[:4])
        + f""", round(corr(table_number, complexity_score), 4) as corr_tables_complexity,
        round(corr(question_length, complexity_score), 4) as corr_length_complexity,
        round(corr(steps_count, complexity_score), 4) as corr_steps_complexity from {_FEATURES}""",
    "distractor_report": f"""select distractor_type, count(*) as count,
        round(avg(complexity_score), 4) as mean_complexity, round(avg(table_number), 4) as mean_table_number
        from {_FEATURES} where subset = 'distractor_bank' group by rollup (distractor_type)""",
    "domain_by_reasoning": f"""select reasoning_type, count(*) filter (domain = 'de') as de,
        count(*) filter (domain = 'en') as en, count(*) filter (domain = 'es') as es,
        count(*) filter (domain = 'fr') as fr from {_FEATURES} group by 1""",
    "complexity_by_answer_type": f"""with q as (select answer_type, quantile_cont(complexity_score, 0.25) as q1,
          median(complexity_score) as median, quantile_cont(complexity_score, 0.75) as q3
          from {_FEATURES} group by 1),
        d as (select f.answer_type, complexity_score as v, q1, median, q3,
          complexity_score between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
          from {_FEATURES} f join q on f.answer_type = q.answer_type)
        select answer_type, count(*) as count, count(*) filter (not inside) as outliers,
          round(any_value(q1), 4) as q1, round(any_value(median), 4) as median,
          round(any_value(q3), 4) as q3, round(min(v) filter (inside), 4) as whisker_low,
          round(max(v) filter (inside), 4) as whisker_high from d group by 1""",
}


def _previews_sql():
    first = []
    for t, (source, _, order, columns) in corpus.CORPUS.items():
        entity = [e for n, e, _ in columns if n == "Entity"]
        value = f"cast(arg_min({entity[0]}, {corpus.key(order, 'duckdb')}) as varchar)" if entity else "max(cast(null as varchar))"
        first.append(f"select '{t}' as table_id, {value} as first_entity from {source}")
    lines = """'rows: ' || row_count || ' | cols: ' || column_count
          || case when numeric_count > 0 then ' | Numeric columns: ' || numeric_count else '' end
          || case when text_count > 0 then ' | Text columns: ' || text_count else '' end"""
    title = "table_id || ': ' || title || coalesce(' (' || year_min || '–' || year_max || ')', '')"
    return first, lines, title


_FIRST, _LINE, _TITLE = _previews_sql()
SQL["table_previews"] = f"""select t.table_id, row_count, {_LINE} as stats, t.{_TITLE} as description,
    f.first_entity, cast(least(row_count, 5) as int) as shown
    from {corpus.tables_sql()} t join ({" union all ".join(_FIRST)}) f on f.table_id = t.table_id"""
SQL["table_previews_full"] = f"""select table_id, cast(least(row_count, 1000) as int) as shown
    from {corpus.tables_sql()}"""
SQL["question_previews"] = f"""with p as (select table_id, {_LINE} as stats, {_TITLE} as description
      from {corpus.tables_sql()} where table_id <> 'table_0003'),
    r as (select question_id, cast(i - 1 as int) as "at", 'table_000' || i as table_id
      from {_Q}, range(1, 4) g(i) where i <= n_tables)
    select question_id, "at", r.table_id, coalesce(stats, 'Table ' || r.table_id || ': not found') as stats,
      description from r left join p on p.table_id = r.table_id"""


def _json_rows(table_id):
    """The first five rows of a table as JSON objects of texts."""
    source, _, order, columns = corpus.CORPUS[table_id]
    pairs = " || ',' || ".join(
        f"to_json('{name}'::varchar)::varchar || ':' || coalesce(to_json(({expr})::varchar)::varchar, 'null')" for name, expr, _ in columns)
    at = corpus.key(order, "duckdb")
    return f"""select '{table_id}' as table_id, string_agg('{{' || {pairs} || '}}', chr(10) order by {at}) as sample_rows
      from (select * from {source} order by {at} limit 5)"""


SQL["preview_texts"] = f"""with s as ({" union all ".join(map(_json_rows, corpus.CORPUS))}),
    c as (select table_id, string_agg(concat(column_name, ':', dtype, ':', n_nulls, ':', sample_value), '; ' order by col_pos)
      as structure from ({corpus.profile_sql()}) group by 1)
    select s.table_id, sample_rows, structure from s join c on c.table_id = s.table_id"""
