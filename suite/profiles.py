"""Profiles, metadata, domains and header alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import corpus, read
from tableworks.functions import domains
from tableworks.functions.columns import col
from tableworks.operators import names, profiling


def profile_columns(spark, folder):
    """All columns of all tables of the corpus in one job."""
    rows = corpus.rows(spark, folder)
    columns = profiling.column_profile(rows, corpus.headers(spark))
    return profiling.with_first_values(columns, rows).drop("min_number", "max_number")


def profile_one_table(spark, folder):
    """One typed table: type, nulls and first value per column."""
    df = read(spark, folder, "customer").select(
        "c_custkey", "c_name", F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("segment"))
    return profiling.profile(df, ["c_custkey"])


def table_shape(spark, folder):
    df = read(spark, folder, "orders").withColumn("Year", F.year("o_orderdate"))
    return profiling.shape(df)


def table_profile(spark, folder):
    df = profiling.table_profile(
        profiling.column_profile(corpus.rows(spark, folder), corpus.headers(spark)))
    return df.withColumns({"numeric_columns": F.array_join("numeric_columns", "|"),
                           "completeness": F.round("completeness", 6)}).drop("columns")


def complexity_level(spark, folder):
    df = profiling.table_metadata(corpus.profiles(spark, folder))
    return df.select("table_id", "row_count", "column_count", "numeric_count", "has_time_series",
                     "complexity_level")


def reasoning_flags(spark, folder):
    df = profiling.table_metadata(corpus.profiles(spark, folder))
    return df.select("table_id", F.array_join("reasoning", ",").alias("reasoning"),
                     "suitable_for_reasoning")


def size_classes(spark, folder):
    df = profiling.table_metadata(corpus.profiles(spark, folder))
    return df.select("table_id", "size_class", F.round("numeric_ratio", 6).alias("numeric_ratio"))


def description_lines(spark, folder):
    df = corpus.profiles(spark, folder)
    return df.select(
        "table_id",
        profiling.description_line(col("table_id"), col("title"), col("year_min"), col("year_max"),
                                   col("row_count"), col("column_count")).alias("description"),
        profiling.description_line(col("table_id"), F.lit(""), F.lit(None).cast("long"),
                                   F.lit(None).cast("long"), col("row_count"),
                                   col("column_count")).alias("fallback"),
        profiling.stats_line(col("row_count"), col("column_count"), col("numeric_count"),
                             col("text_count")).alias("stats"),
    )


def keyword_domain(spark, folder):
    """Domain of every document by its whole text."""
    df = read(spark, folder, "documents").select("doc_id", "text")
    return domains.with_domain(df, col("text"), default=None).drop("text")


def keyword_domain_tables(spark, folder):
    return corpus.profiles(spark, folder).select("table_id", "domain")


def normal_domains(spark, folder):
    """Aliases and unknown names brought to the fixed list of domains."""
    spelled = F.element_at(F.array(*[F.lit(x) for x in _SPELLINGS]),
                           (col("o_custkey") % len(_SPELLINGS) + 1).cast("int"))
    df = read(spark, folder, "orders").select("o_orderkey", spelled.alias("raw"))
    return df.select("o_orderkey", domains.normal_domain(F.nullif("raw", F.lit(""))).alias("domain"))


_SPELLINGS = ["Economic", "tech", "HEALTH", "social_science", "astronomy", "", "Demographic",
              "environmental"]


def domain_distribution(spark, folder):
    df = read(spark, folder, "documents").select("text")
    return domains.domain_distribution(domains.with_domain(df, col("text"), default=None))


def _headers(spark, folder):
    """Each brand as a table whose columns are the names of its parts."""
    return read(spark, folder, "part").groupBy(col("p_brand").alias("table_id")).agg(
        F.array_sort(F.collect_set("p_name")).alias("columns"))


_REQUEST = """case when p_size < 10 then p_name when p_size < 20 then '  ' || upper(p_name)
  when p_size < 30 then '"' || p_name || '"' when p_size < 38 then replace(p_name, ' ', '   ')
  when p_size < 48 then lower(p_type) || ' ' || {noun}
  else lower(p_type) || ' assembly' end"""


def _requests(spark, folder):
    """Part names in several spellings, asked for in the next brand's header."""
    brand = F.concat(F.lit("Brand#"), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 25 + 1)
                     .cast("string"))
    name = F.expr(_REQUEST.format(noun="split_part(p_name, ' ', 2)"))
    return read(spark, folder, "part").select(
        col("p_partkey").alias("req_id"), brand.alias("table_id"), name.alias("name"))


def align_headers(spark, folder):
    df = names.align(_requests(spark, folder), _headers(spark, folder))
    return df.withColumn("score", F.round("score", 6))


def align_headers_exact(spark, folder):
    df = names.align(_requests(spark, folder), _headers(spark, folder), fuzzy=False)
    return df.select("req_id", "column_name", "tier")


def header_suggestions(spark, folder):
    missed = names.align(_requests(spark, folder), _headers(spark, folder), fuzzy=False).filter(
        "column_name is null")
    return names.suggestions(missed, _headers(spark, folder))


QUERIES = {f.__name__: f for f in [
    profile_columns, profile_one_table, table_shape, table_profile, complexity_level,
    reasoning_flags, size_classes, description_lines, keyword_domain, keyword_domain_tables,
    normal_domains, domain_distribution, align_headers, align_headers_exact, header_suggestions,
]}

_HEADER_ROWS = """h as (select p_brand as table_id, p_name as column_name,
  row_number() over (partition by p_brand order by p_name) - 1 as pos
  from (select distinct p_brand, p_name from part))"""
_REQUEST_ROWS = f"""r as (select p_partkey as req_id,
  'Brand#' || (cast(regexp_extract(p_brand, '(\\d+)', 1) as int) % 25 + 1) as table_id,
  {_REQUEST.format(noun="split_part(p_name, ' ', 2)")} as name from part)"""
_EXACT = f"""{_HEADER_ROWS}, {_REQUEST_ROWS},
  e as (select req_id, column_name, pos,
    case when column_name = name then 0 when lower(column_name) = lower(trim(name)) then 1
      when lower(column_name) = lower(trim(replace(name, '"', ''))) then 2
      when lower(column_name) = lower(trim(regexp_replace(replace(name, '"', ''), '\\s+', ' ', 'g'))) then 3
      end as tier from r join h on h.table_id = r.table_id),
  x as (select req_id, column_name, tier from e where tier is not null
    qualify row_number() over (partition by req_id order by tier, pos) = 1)"""
_TIER = "['exact', 'case', 'quotes', 'spaces'][tier + 1]"

SQL = {
    "profile_columns": corpus.profile_sql(),
    "profile_one_table": """select 0 as col_pos, 'c_custkey' as column_name, 'bigint' as dtype,
          count(*) as n_rows, 0::bigint as n_nulls, cast(arg_min(c_custkey, c_custkey) as varchar) as sample_value
          from customer
        union all select 1, 'c_name', 'string', count(*), 0, arg_min(c_name, c_custkey) from customer
        union all select 2, 'segment', 'string', count(*), count(*) filter (c_mktsegment = 'MACHINERY'),
          arg_min(c_mktsegment, c_custkey) filter (c_mktsegment <> 'MACHINERY') from customer""",
    "table_shape": """select count(*) as row_count, 7::bigint as column_count, 4::bigint as numeric_count,
        true as has_time_series from orders""",
    "table_profile": f"""select table_id, row_count, column_count, numeric_count, text_count,
        numeric_columns, has_time_series, round(completeness, 6) as completeness, year_min, year_max
        from {corpus.tables_sql()}""",
    "complexity_level": f"""select table_id, row_count, column_count, numeric_count, has_time_series,
        complexity_level from {corpus.metadata_sql()}""",
    "reasoning_flags": f"""select table_id, reasoning, reasoning <> '' as suitable_for_reasoning
        from {corpus.metadata_sql()}""",
    "size_classes": f"""select table_id, size_class, round(numeric_ratio, 6) as numeric_ratio
        from {corpus.metadata_sql()}""",
    "description_lines": f"""select table_id,
        table_id || ': ' || title || coalesce(' (' || year_min || '–' || year_max || ')', '') as description,
        table_id || ': ' || row_count || ' rows, ' || column_count || ' columns' as fallback,
        'rows: ' || row_count || ' | cols: ' || column_count
          || case when numeric_count > 0 then ' | Numeric columns: ' || numeric_count else '' end
          || case when text_count > 0 then ' | Text columns: ' || text_count else '' end as stats
        from {corpus.tables_sql()}""",
    "keyword_domain": f"select doc_id, {corpus.domain_sql('text')} as domain from documents",
    "keyword_domain_tables": f"select table_id, domain from {corpus.metadata_sql()}",
    "normal_domains": """select o_orderkey, ['economics', 'technology', 'health', 'general', 'general',
        'general', 'demographics', 'environment'][o_custkey % 8 + 1] as domain from orders""",
    "domain_distribution": f"""with c as (select {corpus.domain_sql('text')} as domain, count(*) as count
          from documents group by 1)
        select d.domain, coalesce(c.count, 0) as count from (values ('economics'), ('demographics'),
          ('health'), ('education'), ('environment'), ('technology'), ('general')) d(domain)
        left join c on c.domain = d.domain""",
    "align_headers": f"""with {_EXACT},
        s as (select req_id, column_name, pos, name, list_distinct(string_split(trim(regexp_replace(
            replace(lower(name), '"', ''), '\\s+', ' ', 'g')), ' ')) as t,
          trim(regexp_replace(replace(name, '"', ''), '\\s+', ' ', 'g')) as n,
          list_distinct(string_split(lower(column_name), ' ')) as c
          from r join h on h.table_id = r.table_id where req_id not in (select req_id from x)),
        m as (select *, len(list_intersect(t, c)) as common from s),
        f as (select req_id, column_name, pos, common, common / len(t) as overlap,
          common / len(t) * 0.5 + common / len(c) * 0.3
          + (1 - abs(length(n) - length(column_name)) / greatest(length(n), length(column_name))) * 0.2 as score
          from m where common > 0),
        b as (select req_id, column_name, score from f where score > 0.3 qualify row_number() over
          (partition by req_id order by score desc, common desc, overlap desc, pos) = 1)
        select r.req_id, r.table_id, r.name, coalesce(x.column_name, b.column_name) as column_name,
          coalesce({_TIER}, case when b.req_id is not null then 'words' end) as tier,
          round(b.score, 6) as score
        from r left join x on x.req_id = r.req_id left join b on b.req_id = r.req_id""",
    "align_headers_exact": f"""with {_EXACT} select r.req_id, x.column_name, {_TIER} as tier
        from r left join x on x.req_id = r.req_id""",
    "header_suggestions": f"""with {_EXACT},
        w as (select distinct table_id, name from r where req_id not in (select req_id from x)),
        n as (select w.table_id, name, column_name, pos from w join h on h.table_id = w.table_id
          where contains(lower(column_name), lower(name)) or contains(lower(name), lower(column_name))),
        a as (select * from n union all select w.table_id, name, column_name, pos from w
          join h on h.table_id = w.table_id where pos < 5
          and (w.table_id, name) not in (select (table_id, name) from n))
        select table_id, name, column_name as suggestion,
          cast(row_number() over (partition by table_id, name order by pos) - 1 as int) as rank from a""",
}
