"""Cleaning steps, the full pipeline over one table, and the pipeline over a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import read
from tableworks.functions.columns import col
from tableworks.operators import cleaning, profiling

# A dirty view of part, in expressions both engines understand: duplicates, nulls, money texts.
_DIRTY = [
    ("Entity", "nullif(p_brand, 'Brand#3')"),
    ("Year", "1990 + p_size"),
    ("Kind", "nullif(p_type, 'PROMO')"),
    ("  Price   band ", "concat('$', cast(cast(floor(p_retailprice / 100) as int) as varchar(9)), ',000.50')"),
    ("Size", "nullif(p_size, 7)"),
    ("Mostly text", "case when p_size < 12 then concat(cast(p_size as varchar(9)), '%') else p_name end"),
    ("Empty", "nullif(p_type, p_type)"),
    ("Unnamed: 7", "p_name"),
]

# The caps are asked for; without them every row is kept.
CAPPED = cleaning.Policy(max_rows=1000, max_entities=300)


def _dirty(spark, folder):
    df = read(spark, folder, "part")
    return df.select(*[F.expr(e).alias(n) for n, e in _DIRTY], col("p_partkey").alias("_pos"))


_DIRTY_SQL = "(select " + ", ".join(f'{e} as "{n}"' for n, e in _DIRTY) + ", p_partkey as _pos from part)"


def clean_empty_rows(spark, folder):
    """Rows without any value go; the other values stay as they are."""
    df = read(spark, folder, "part").select(
        F.expr("case when p_size > 25 then p_brand end").alias("brand"),
        F.expr("case when p_size > 20 then p_size end").alias("size"), "p_partkey")
    return cleaning.drop_empty_rows(df, ["brand", "size"])


def clean_columns(spark, folder):
    """Empty and unnamed columns go, names get single blanks."""
    df = cleaning.drop_unnamed(cleaning.drop_empty_columns(_dirty(spark, folder)))
    return cleaning.standard_names(df)


def _filled(spark, folder, **policy):
    df = _dirty(spark, folder).select("Entity", "Size", "Kind", "_pos")
    return cleaning.impute(df, cleaning.Policy(**policy), ["_pos"])


def clean_impute_mean(spark, folder):
    return _filled(spark, folder, numeric="mean").withColumn("Size", F.round("Size", 6))


def clean_impute_median(spark, folder):
    return _filled(spark, folder, numeric="median").withColumn("Size", F.round("Size", 6))


def clean_impute_mode(spark, folder):
    return _filled(spark, folder, categorical="mode")


def clean_coerce_numeric(spark, folder):
    df = _dirty(spark, folder).select("Entity", "  Price   band ", "Mostly text", "_pos")
    return cleaning.texts_to_numbers(df)


def clean_dedupe(spark, folder):
    """Equal rows once, with the first stored position."""
    df = _dirty(spark, folder).select("Entity", "Year", "Kind", "_pos")
    return cleaning.drop_duplicates(df, ["_pos"])


def clean_entity_cap(spark, folder):
    df = read(spark, folder, "orders").select(
        F.expr("nullif(o_custkey, 5)").alias("Entity"), "o_orderkey")
    return cleaning.cap_entities(df, "Entity", 300)


def clean_entity_cap_idle(spark, folder):
    """Few entities: nothing goes, not even the null entity."""
    df = read(spark, folder, "orders").select(
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("Entity"), "o_orderkey")
    return cleaning.cap_entities(df, "Entity", 300).groupBy("Entity").agg(
        F.count(F.lit(1)).alias("n"))


def clean_table(spark, folder):
    return cleaning.clean(_dirty(spark, folder), ["_pos"], CAPPED).table


def _report(df):
    return df.withColumn("data_completeness", F.round("data_completeness", 6))


def clean_report(spark, folder):
    return _report(cleaning.clean(_dirty(spark, folder), ["_pos"], CAPPED, "part").report)


def clean_table_uncapped(spark, folder):
    """Filling policies and no caps: mean for numbers, most frequent text."""
    policy = cleaning.Policy(numeric="mean", categorical="mode", max_rows=None, max_entities=None)
    table = cleaning.clean(_dirty(spark, folder), ["_pos"], policy).table
    return table.withColumn("Size", F.round("Size", 6))


def clean_report_median(spark, folder):
    policy = cleaning.Policy(numeric="median", categorical="mode", max_rows=1000, max_entities=300)
    return _report(cleaning.clean(_dirty(spark, folder), ["_pos"], policy, "part").report)


def clean_rejected(spark, folder):
    """Verdicts on a table that is too narrow, one too empty and one with too few rows left."""
    narrow = read(spark, folder, "region").withColumnRenamed("r_name", "Entity")
    parts = read(spark, folder, "part")
    empty = parts.select(
        col("p_partkey").alias("_pos"),
        *[F.expr(f"case when p_size = 7 and p_type = 'PROMO' then {e} end").alias(n) for n, e in
          [("Entity", "p_brand"), ("a", "p_name"), ("b", "p_retailprice"), ("c", "p_type")]],
        F.expr("case when p_partkey >= 0 then 1 end").alias("d"))
    lost = parts.select(
        col("p_partkey").alias("_pos"), F.expr("nullif(p_brand, p_brand)").alias("Country"),
        F.expr("case when p_partkey = 0 then p_brand end").alias("Entity"), "p_name", "p_size")
    reports = [
        cleaning.clean(narrow, ["r_regionkey"], name="narrow").report,
        cleaning.clean(empty, ["_pos"], cleaning.Policy(max_missing_ratio=0.7), "empty").report,
        cleaning.clean(lost, ["_pos"], name="lost").report,
    ]
    return _report(reduce(DataFrame.unionByName, reports))


_CORPUS = {
    "dirty": ("part", "p_partkey", _DIRTY),
    "orders": ("orders", "o_orderkey", [
        ("Entity", "o_custkey"), ("Year", "year(o_orderdate)"), ("Total", "o_totalprice")]),
    "region": ("region", "r_regionkey", [("Entity", "r_name"), ("Code", "r_regionkey")]),
    "texts": ("customer", "c_custkey", [
        ("Country", "c_name"), ("Segment", "c_mktsegment"), ("Tier", "concat('tier ', c_mktsegment)")]),
}


def _corpus(spark, folder):
    parts, headers = [], {}
    for table_id, (source, order, columns) in _CORPUS.items():
        typed = read(spark, folder, source).select(
            col(order), *[F.expr(e).alias(n) for n, e in columns])
        parts.append(profiling.corpus_rows(typed, table_id, order, [n for n, _ in columns]))
        headers[table_id] = [n for n, _ in columns]
    return reduce(DataFrame.union, parts), profiling.corpus_headers(spark, headers)


def clean_corpus_report(spark, folder):
    """One verdict and summary per table of the corpus."""
    return _report(cleaning.clean_corpus(*_corpus(spark, folder), CAPPED).report)


def clean_corpus_rows(spark, folder):
    """Cleaned rows of all tables that passed."""
    cleaned = cleaning.clean_corpus(*_corpus(spark, folder), CAPPED).rows
    return cleaned.select("table_id", "pos",
                          F.array_join("cells", "|", "-").alias("cells"))


def clean_corpus_headers(spark, folder):
    cleaned = cleaning.clean_corpus(*_corpus(spark, folder), CAPPED).headers
    return cleaned.select("table_id", F.array_join("columns", "|").alias("columns"))


def clean_rejected_late(spark, folder):
    """Final verdicts: too few entities, numeric columns without a value, too incomplete."""
    parts = read(spark, folder, "part")
    shape = lambda **exprs: parts.select(col("p_partkey").alias("_pos"), *[F.expr(e).alias(n) for n, e in exprs.items()])
    entities = shape(Country="p_type", Entity="case when p_size = 10 then p_brand end", Size="p_size")
    numbers = shape(Entity="case when p_size < 30 then p_name end", Kind="p_type",
                    Size="case when p_size >= 30 then p_size end")
    sparse = shape(Entity="p_brand", Size="p_size", **{f"t{i}": f"case when p_size = {i} then p_name end" for i in range(5)})
    reports = [
        cleaning.clean(entities, ["_pos"], name="entities").report,
        cleaning.clean(numbers, ["_pos"], name="numbers").report,
        cleaning.clean(sparse, ["_pos"], cleaning.Policy(numeric="mean", min_completeness=0.5), "sparse").report,
    ]
    return _report(reduce(DataFrame.unionByName, reports))


def _filled_corpus(spark, folder, **policy):
    """Rows of the dirty table after the corpus was cleaned with a filling policy."""
    rows = cleaning.clean_corpus(*_corpus(spark, folder), cleaning.Policy(**policy)).rows.filter("table_id = 'dirty'")
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select("pos", cell(0).alias("Entity"), cell(1).cast("int").alias("Year"), cell(2).alias("Kind"),
                       cell(3).cast("double").alias("Price band"), F.round(cell(4).cast("double"), 6).alias("Size"),
                       cell(5).alias("Mostly text"))


def clean_corpus_mean(spark, folder):
    return _filled_corpus(spark, folder, numeric="mean", categorical="mode")


def clean_corpus_median(spark, folder):
    return _filled_corpus(spark, folder, numeric="median", categorical="mode")


def clean_corpus_mode(spark, folder):
    return _filled_corpus(spark, folder, categorical="mode")


def clean_corpus_report_median(spark, folder):
    """Verdicts with filled cells, without caps."""
    policy = cleaning.Policy(numeric="median", categorical="mode")
    return _report(cleaning.clean_corpus(*_corpus(spark, folder), policy).report)


QUERIES = {f.__name__: f for f in [
    clean_empty_rows, clean_columns, clean_impute_mean, clean_impute_median, clean_impute_mode,
    clean_coerce_numeric, clean_dedupe, clean_entity_cap, clean_entity_cap_idle, clean_table,
    clean_report, clean_table_uncapped, clean_report_median, clean_rejected, clean_corpus_report,
    clean_corpus_rows, clean_corpus_headers, clean_rejected_late, clean_corpus_mean, clean_corpus_median,
    clean_corpus_mode, clean_corpus_report_median,
]}

_MONEY = "try_cast(regexp_replace({}, '[,$%]', '', 'g') as double)"
_PRICE = _MONEY.format('"  Price   band "')
_KEPT = f"""(select "Entity", "Year", "Kind", {_PRICE} as "Price band", "Size", "Mostly text",
  min(_pos) as _pos from {_DIRTY_SQL} where "Entity" is not null group by all)"""
_CLEAN = f"(select * from {_KEPT} order by _pos limit 1000)"
_FILLED = f"""(select "Entity", "Year",
    coalesce("Kind", (select "Kind" from {_DIRTY_SQL} where "Kind" is not null group by 1
      order by count(*) desc, 1 limit 1)) as "Kind", {_PRICE} as "Price band",
    {{size}} as "Size", "Mostly text", min(_pos) as _pos
  from {_DIRTY_SQL} where "Entity" is not null group by all)"""
_MEAN = _FILLED.format(size=f'coalesce("Size", (select avg("Size") from {_DIRTY_SQL}))')
_MEDIAN = _FILLED.format(size=f'coalesce("Size", (select median("Size") from {_DIRTY_SQL}))')


def _summary(name, table, columns, numeric, original, width, from_table):
    """Report row of a table that passed."""
    present = " + ".join(f'count("{c}")' for c in columns)
    return f"""select '{name}' as table_id, true as passed, cast(null as varchar) as reason,
      (select count(*) from {original}) as original_rows, {width}::bigint as original_columns,
      count(*) as final_rows, {len(columns)}::bigint as final_columns,
      (select count(*) from {original}) - count(*) as rows_removed,
      {width - len(columns)}::bigint as columns_removed,
      round(({present}) / (count(*) * {len(columns)}), 6) as data_completeness,
      {numeric}::bigint as numeric_columns from {from_table}"""


def _rejected(name, reason, original, width):
    return f"""select '{name}' as table_id, false as passed, '{reason}' as reason,
      count(*) as original_rows, {width}::bigint as original_columns, 0::bigint as final_rows,
      0::bigint as final_columns, count(*) as rows_removed, {width}::bigint as columns_removed,
      0.0::double as data_completeness, 0::bigint as numeric_columns from {original}"""


_FINAL = ["Entity", "Year", "Kind", "Price band", "Size", "Mostly text"]
_ORDER_CAP = """(with o as (select o_custkey as "Entity", year(o_orderdate) as "Year",
    o_totalprice as "Total", min(o_orderkey) as _pos from orders group by all),
  c as (select * from o order by _pos limit 1000)
  select * from c where (select count(distinct "Entity") from c) <= 300 or "Entity" in
    (select "Entity" from c group by 1 order by count(*) desc, cast("Entity" as varchar) limit 300))"""

SQL = {
    "clean_empty_rows": """select case when p_size > 25 then p_brand end as brand,
        case when p_size > 20 then p_size end as size, p_partkey from part where p_size > 20""",
    "clean_columns": f"""select "Entity", "Year", "Kind", "  Price   band " as "Price band", "Size",
        "Mostly text", _pos from {_DIRTY_SQL}""",
    "clean_impute_mean": f"""select "Entity", round(coalesce("Size", (select avg("Size") from {_DIRTY_SQL})), 6)
        as "Size", "Kind", _pos from {_DIRTY_SQL}""",
    "clean_impute_median": f"""select "Entity", round(coalesce("Size", (select median("Size") from {_DIRTY_SQL})), 6)
        as "Size", "Kind", _pos from {_DIRTY_SQL}""",
    "clean_impute_mode": f"""select "Entity", "Size", coalesce("Kind", (select "Kind" from {_DIRTY_SQL}
        where "Kind" is not null group by 1 order by count(*) desc, 1 limit 1)) as "Kind", _pos
        from {_DIRTY_SQL}""",
    "clean_coerce_numeric": f"""select "Entity", {_PRICE} as "  Price   band ", "Mostly text", _pos
        from {_DIRTY_SQL}""",
    "clean_dedupe": f"""select "Entity", "Year", "Kind", min(_pos) as _pos from {_DIRTY_SQL} group by 1, 2, 3""",
    "clean_entity_cap": """with o as (select nullif(o_custkey, 5) as "Entity", o_orderkey from orders),
        t as (select "Entity" from o where "Entity" is not null group by 1 order by count(*) desc, 1 limit 300)
        select * from o where (select count(distinct "Entity") from o) <= 300 or "Entity" in (select * from t)""",
    "clean_entity_cap_idle": """select nullif(o_orderpriority, '5-LOW') as "Entity", count(*) as n
        from orders group by 1""",
    "clean_table": f'select * from {_CLEAN}',
    "clean_report": _summary("part", _CLEAN, _FINAL, 3, "part", 8, _CLEAN),
    "clean_table_uncapped": f'select * replace (round("Size", 6) as "Size") from {_MEAN}',
    "clean_report_median": _summary("part", None, _FINAL, 3, "part", 8,
                                    f"(select * from {_MEDIAN} order by _pos limit 1000)"),
    "clean_rejected": " union all ".join([
        _rejected("narrow", "too small", "region", 1),
        _rejected("empty", "too many missing values", "part", 5),
        _rejected("lost", "too few rows after missing values", "part", 4)]),
    "clean_corpus_report": " union all ".join([
        _summary("dirty", _CLEAN, _FINAL, 3, "part", 8, _CLEAN),
        _summary("orders", _ORDER_CAP, ["Entity", "Year", "Total"], 3, "orders", 3, _ORDER_CAP),
        _rejected("region", "too small", "region", 2),
        _rejected("texts", "too few numeric columns", "customer", 3)]),
    "clean_corpus_rows": f"""select 'dirty' as table_id, _pos as pos, concat_ws('|', coalesce("Entity", '-'),
          "Year", coalesce("Kind", '-'), "Price band", coalesce("Size" || '.0', '-'), "Mostly text") as cells
          from {_CLEAN}
        union all select 'orders', _pos, concat_ws('|', "Entity", "Year", "Total") from {_ORDER_CAP}""",
    "clean_rejected_late": " union all ".join([
        _rejected("entities", "too few entities", "part", 3),
        _rejected("numbers", "no numeric values", "part", 3),
        _rejected("sparse", "too incomplete", "part", 7)]),
    **{f"clean_corpus_{name}": f"""select _pos as pos, "Entity", cast("Year" as int) as "Year", "Kind", "Price band",
        round(cast("Size" as double), 6) as "Size", "Mostly text" from {table}"""
       for name, table in {"mean": _MEAN, "median": _MEDIAN, "mode": _FILLED.format(size='"Size"')}.items()},
    "clean_corpus_report_median": " union all ".join([
        _summary("dirty", None, _FINAL, 3, "part", 8, _MEDIAN),
        _summary("orders", None, ["Entity", "Year", "Total"], 3, "orders", 3, """(select o_custkey as "Entity",
          year(o_orderdate) as "Year", o_totalprice as "Total" from orders group by all)"""),
        _rejected("region", "too small", "region", 2),
        _rejected("texts", "too few numeric columns", "customer", 3)]),
    "clean_corpus_headers": """select 'dirty' as table_id, 'Entity|Year|Kind|Price band|Size|Mostly text' as columns
        union all select 'orders', 'Entity|Year|Total'""",
}
