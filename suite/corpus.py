"""The test tables seen as a corpus of tables, in Spark and in DuckDB.

Each entry: source table, title, order key, and columns as (name, expression valid in both engines,
kind). Some cells are blanked so that null rules show.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import read
from tableworks.operators import profiling

# lineitem has no key of one column: 60 bits of a digest of the whole key stand for the stored order
_LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
LINE_KEY = {
    "spark": f"cast(conv(substring(md5({_LINE}), 1, 15), 16, 10) as bigint)",
    "duckdb": f"cast(concat('0x', substring(md5({_LINE}), 1, 15)) as bigint)",
}


def key(order, engine):
    return order if isinstance(order, str) else order[engine]


CORPUS = {
    "table_0001": ("region", "Regions of trade", "r_regionkey", [
        ("Region", "r_name", "text"), ("Code", "r_regionkey", "int")]),
    "table_0002": ("nation", "Population by nation", "n_nationkey", [
        ("Country", "n_name", "text"), ("Code", "n_nationkey", "int"),
        ("Region code", "case when n_regionkey > 0 then n_regionkey end", "int")]),
    "table_0003": ("customer", "Customer wealth", "c_custkey", [
        ("Entity", "c_name", "text"), ("Nation", "c_nationkey", "int"),
        ("Balance", "case when c_acctbal > 0 then c_acctbal end", "float"),
        ("Segment", "nullif(c_mktsegment, 'MACHINERY')", "text")]),
    "table_0004": ("supplier", "Supplier energy use", "s_suppkey", [
        ("Entity", "s_name", "text"), ("Nation", "s_nationkey", "int"),
        ("Balance", "s_acctbal", "float")]),
    "table_0005": ("part", "School material", "p_partkey", [
        ("Entity", "p_name", "text"), ("Brand", "nullif(p_brand, 'Brand#3')", "text"),
        ("Kind", "p_type", "text"), ("Size", "nullif(p_size, 7)", "int"),
        ("Price", "p_retailprice", "float"), ("Notes", "nullif(p_type, p_type)", "none")]),
    "table_0006": ("orders", "Orders over time", "o_orderkey", [
        ("Entity", "o_orderpriority", "text"), ("Year", "year(o_orderdate)", "int"),
        ("Customer", "o_custkey", "int"), ("Status", "o_orderstatus", "text"),
        ("Total price", "o_totalprice", "float")]),
    "table_0007": ("lineitem", "Lines of the industry",
                   LINE_KEY, [
        ("Order", "l_orderkey", "int"), ("Year", "year(l_shipdate)", "int"),
        ("Part", "l_partkey", "int"), ("Supplier", "l_suppkey", "int"),
        ("Quantity", "l_quantity", "float"), ("Price", "l_extendedprice", "float"),
        ("Discount", "nullif(l_discount, 0.05)", "float"), ("Tax", "l_tax", "float"),
        ("Flag", "l_returnflag", "text"), ("Line status", "l_linestatus", "text"),
        ("Line number", "l_linenumber", "int")]),
    "table_0008": ("events", "Internet activity", "event_id", [
        ("Entity", "event_type", "text"), ("User", "user_id", "int"), ("Value", "value", "float"),
        ("Props", "props", "text")]),
    "table_0009": ("documents", "Written prose", "doc_id", [
        ("Id", "doc_id", "int"), ("Text", "text", "text"), ("Language", "lang", "text"),
        ("Source", "source", "text"), ("Length", "n_chars", "int")]),
    "table_0010": ("labels", "Health of documents", "doc_id", [
        ("Id", "doc_id", "int"), ("Quality", "quality", "int"), ("Toxic", "toxic", "int")]),
}


def rows(spark, folder) -> DataFrame:
    """Every row of every table of the corpus."""
    parts = []
    for table_id, (source, _, order, columns) in CORPUS.items():
        df = read(spark, folder, source)
        typed = df.select(
            F.expr(key(order, "spark")).alias("_pos"), *[F.expr(e).alias(n) for n, e, _ in columns])
        parts.append(profiling.corpus_rows(typed, table_id, "_pos", [n for n, _, _ in columns]))
    return reduce(DataFrame.union, parts)


def headers(spark) -> DataFrame:
    """Names and, where the source tables have one, types of all columns."""
    return profiling.corpus_headers(
        spark, {t: [n for n, _, _ in spec[3]] for t, spec in CORPUS.items()},
        {t: [None if k == "none" else k for _, _, k in spec[3]] for t, spec in CORPUS.items()})


def titles(spark) -> DataFrame:
    return spark.createDataFrame([(t, s[1]) for t, s in CORPUS.items()], "table_id string, title string")


def profile_sql() -> str:
    """Column profile of the whole corpus."""
    selects = []
    for table_id, (source, _, order, columns) in CORPUS.items():
        at = key(order, "duckdb")
        for i, (name, expr, kind) in enumerate(columns):
            numbers = f"count({expr})" if kind in ("int", "float") else "0"
            dtype = {
                "int": f"case when count({expr}) = count(*) then 'int64' else 'float64' end",
                "float": "'float64'", "none": "'float64'", "text": "'object'",
            }[kind]
            selects.append(f"""select '{table_id}' as table_id, {i} as col_pos, '{name}' as column_name,
              count(*) as n_rows, count(*) - count({expr}) as n_nulls,
              cast({numbers} as bigint) as n_numbers, {dtype} as dtype,
              coalesce(arg_min(cast({expr} as varchar), {at}) filter (({expr}) is not null), 'No data')
              as sample_value from {source}""")
    return " union all ".join(selects)


def tables_sql() -> str:
    """Table profile with title: one row per table."""
    years = " union all ".join(
        f"""select '{t}' as table_id, min({e}) as year_min, max({e}) as year_max from {s[0]}"""
        for t, s in CORPUS.items() for n, e, _ in s[3] if n == "Year")
    names = ", ".join(f"('{t}', '{s[1]}')" for t, s in CORPUS.items())
    return f"""(with p as ({profile_sql()}), y as ({years}),
      t as (select * from (values {names}) v(table_id, title))
      select p.table_id, any_value(t.title) as title, max(n_rows) as row_count,
        count(*) as column_count, count(*) filter (dtype in ('int64', 'float64')) as numeric_count,
        count(*) filter (dtype = 'object') as text_count,
        list(column_name order by col_pos) as columns,
        array_to_string(list(column_name order by col_pos) filter (dtype in ('int64', 'float64')), '|')
          as numeric_columns,
        coalesce(bool_or(column_name = 'Year' and dtype in ('int64', 'float64')), false) as has_time_series,
        1 - sum(n_nulls) / sum(n_rows) as completeness,
        cast(any_value(y.year_min) as bigint) as year_min,
        cast(any_value(y.year_max) as bigint) as year_max
      from p join t on t.table_id = p.table_id left join y on y.table_id = p.table_id
      group by p.table_id)"""


def profiles(spark, folder) -> DataFrame:
    """Table profiles with title and keyword domain."""
    from tableworks.functions import domains
    columns = profiling.column_profile(rows(spark, folder), headers(spark))
    table = profiling.table_profile(columns).join(titles(spark), "table_id")
    text = F.concat_ws(" ", "title", F.array_join("columns", " "))
    return domains.with_domain(table, text)


def domain_sql(text: str) -> str:
    from tableworks.functions.domains import KEYWORDS
    branches = " ".join(
        "when " + " or ".join(f"contains(lower({text}), '{k}')" for k in found) + f" then '{d}'"
        for d, found in KEYWORDS.items())
    return f"case {branches} end"


def metadata_sql() -> str:
    """Metadata record per table: profile, domain, complexity, reasoning, size."""
    return f"""(with t as (select *, coalesce({domain_sql("title || ' ' || array_to_string(columns, ' ')")},
        'general') as domain, numeric_count / column_count as numeric_ratio from {tables_sql()}),
      s as (select *, (case when row_count > 200 then 1 else 0 end)
        + (case when column_count > 20 then 2 when column_count > 10 then 1 else 0 end)
        + (case when numeric_ratio >= 0.75 then 1 else 0 end)
        + (case when has_time_series then 1 else 0 end) as points from t)
      select *, case when points >= 4 then 'high' when points >= 2 then 'medium' else 'low' end
          as complexity_level,
        case when row_count < 100 then 'small' when row_count <= 500 then 'medium' else 'large' end
          as size_class,
        concat_ws(',', case when numeric_count >= 1 then 'arithmetic_aggregation' end,
          case when column_count > 3 and numeric_count >= 1 then 'conditional_reasoning' end,
          case when list_contains(columns, 'Entity') or list_contains(columns, 'Country')
            then 'entity_comparison' end,
          case when has_time_series then 'temporal_analysis' end) as reasoning
      from s)"""
