"""Sources, sinks and the catalogue, over data written from the test tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import corpus, read
from tableworks.functions.columns import col
from tableworks.functions.text import MISSING_TOKENS
from tableworks.operators import cleaning, profiling
from tableworks.operators import relational as rel
from tableworks.plans import catalog
from tableworks.session import scratch_path
from tableworks.sources import readers, schemas, sinks


def _gaps(spark, folder):
    return read(spark, folder, "customer").select(
        "c_custkey", "c_name", F.expr("case when c_acctbal > 0 then c_acctbal end").alias("c_acctbal"),
        F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("c_mktsegment"))


def load_table(spark, folder):
    """A bundle written and read back by id, processed and raw, by name."""
    base = scratch_path(spark, "tables")
    customers = read(spark, folder, "customer")
    sinks.write_bundle(base, "table_0001", _gaps(spark, folder), raw=customers)
    readers.load_as(spark, base, "table_0001", "tw_customers")
    raw = readers.load(spark, base, "table_0001", "raw").select("c_custkey", "c_nationkey")
    return rel.join(rel.use(spark, "tw_customers"), raw, ["c_custkey"])


#: The cap of the reports below.
CAPPED = cleaning.Policy(max_rows=1000)


def bundle_documents(spark, folder):
    """Metadata and quality documents of written bundles, read back and joined."""
    base = scratch_path(spark, "tables")
    for i, table in enumerate(["customer", "supplier", "part"]):
        df = read(spark, folder, table)
        meta = profiling.shape(df).select(
            F.lit(table).alias("title"), "row_count", "column_count", "has_time_series")
        report = cleaning.clean(df.withColumn("_pos", col(df.columns[0])), ["_pos"], CAPPED).report
        quality = report.select(
            F.col("passed").alias("success"),
            F.array("original_rows", "original_columns").alias("original_shape"),
            F.array("final_rows", "final_columns").alias("final_shape"),
            "rows_removed", "columns_removed", "data_completeness", "numeric_columns")
        sinks.write_bundle(base, f"table_{i + 1:04d}", df, meta=meta, quality=quality)
    found = readers.existing_tables(spark, base)
    meta = readers.read_documents(spark, f"{base}/*/meta.json", schemas.META)
    quality = readers.read_documents(spark, f"{base}/*/quality_report.json", schemas.QUALITY)
    table_of = F.regexp_extract("_path", "/(table_[^/]*)/", 1)
    both = meta.join(quality.withColumn("table_id", table_of).drop("numeric_columns"), "table_id")
    return found.join(both, "table_id").select(
        "table_id", "title", "row_count", "column_count", "success",
        F.element_at("final_shape", 1).alias("final_rows"), "rows_removed",
        F.round("data_completeness", 6).alias("data_completeness"))


def csv_round_trip(spark, folder):
    """CSV without a schema: types, missing cells and values survive."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(_gaps(spark, folder), path)
    return readers.read_csv(spark, path).drop("_pos")


def csv_with_schema(spark, folder):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_gaps(spark, folder), path)
    df = readers.read_csv(
        spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING")
    return rel.group_aggregate(df, ["c_mktsegment"], [("count", "c_custkey"), ("max", "c_acctbal")])


def _datasets(spark, folder):
    root = scratch_path(spark, "datasets")
    for table in ["customer", "supplier", "part", "region"]:
        df = read(spark, folder, table)
        sinks.write_csv(df, f"{root}/{table}_data/table.csv")
        text = F.to_json(F.struct(F.lit(f"The {table} table").alias("title"),
                                  F.count(F.lit(1)).alias("rows")))
        manifest = df.agg(text.alias("value"))
        if table == "part":  # no object
            manifest = df.agg(F.to_json(F.array(F.count(F.lit(1)))).alias("value"))
        manifest.write.text(f"{root}/{table}_data/datapackage.json")
    sinks.write_csv(read(spark, folder, "nation"), f"{root}/nation_data/table.csv")
    return root


#: Columns of the tables that are written and read cell by cell; numbers, dates and texts.
_WRITTEN = {"documents": ["doc_id", "text", "lang", "source", "n_chars"],
            "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}


def scan_datasets(spark, folder):
    """Folders with a manifest and a CSV file; the one without a manifest is left out."""
    return readers.scan_datasets(spark, _datasets(spark, folder), max_mb=50).select("dataset")


def check_structure(spark, folder):
    return readers.check_structure(spark, _datasets(spark, folder))


def manifests(spark, folder):
    return readers.manifests(spark, _datasets(spark, folder)).select("dataset", "title")


def corpus_csv(spark, folder):
    """All CSV files of a folder read as one corpus and profiled."""
    rows, headers = readers.read_corpus(spark, _datasets(spark, folder))
    return profiling.column_profile(rows, headers).drop("first_pos", "min_number", "max_number")


def csv_cells(spark, folder):
    """Prose with line breaks and quotes, orders, and nations with surplus cells, read back cell by cell."""
    root = scratch_path(spark, "cells")
    for table, columns in _WRITTEN.items():
        sinks.write_csv(read(spark, folder, table).select(*columns), f"{root}/{table}_data/table.csv")
    nation = read(spark, folder, "nation").select(
        F.lit(1).alias("part"), "n_nationkey", F.concat_ws(
            ",", "n_nationkey", "n_name", F.expr("case when n_nationkey % 3 = 0 then concat('more,', n_regionkey) end")).alias("line"))
    head = nation.limit(1).select(F.lit(0).alias("part"), "n_nationkey", F.lit("key,name").alias("line"))
    # written as it is: no line holds the separator or a quote
    head.union(nation).repartition(1).sortWithinPartitions("part", "n_nationkey").select("line").write.option(
        "sep", "|").csv(f"{root}/nation_data/table.csv")
    rows, _ = readers.read_corpus(spark, root)
    return rows.select(F.col("table_id").alias("dataset"), *(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(5)),
                       F.array_join("surplus", "/").alias("surplus"))


def corpus_store(spark, folder):
    """A corpus written as two datasets and read back."""
    path = scratch_path(spark, "corpus")
    sinks.write_corpus(path, corpus.rows(spark, folder), corpus.headers(spark))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("width"))


def incremental_skip(spark, folder):
    """Customers that are no suppliers' namesakes yet, the first 100 by name."""
    names = read(spark, folder, "customer").select(F.regexp_extract("c_name", "#(.*)", 1).alias("dataset"))
    stored = read(spark, folder, "supplier").select(
        F.regexp_extract("s_name", "#(.*)", 1).alias("original_name"))
    return readers.new_datasets(names, stored, 100)


def assign_ids(spark, folder):
    names = read(spark, folder, "customer").select("c_name")
    return sinks.assign_ids(names, "c_name", existing=129)


def append_log(spark, folder):
    """Two batches of records appended to one log."""
    path = scratch_path(spark, "log")
    events = read(spark, folder, "events").select("event_id", "event_type", "value")
    sinks.append_records(events.filter("event_type = 'error'"), path)
    sinks.append_records(events.filter("event_type <> 'error'"), path)
    return spark.read.schema("event_id BIGINT, event_type STRING, value DOUBLE").json(path)


def domain_index(spark, folder):
    return catalog.domain_index(corpus.profiles(spark, folder))


def index_statistics(spark, folder):
    """Means over all stored tables, one of which has no metadata."""
    tables = corpus.profiles(spark, folder)
    ids = tables.select("table_id").union(spark.sql("select 'table_9999'"))
    df = catalog.index_statistics(ids, tables)
    return df.select("total_tables", F.round("avg_rows", 4).alias("avg_rows"),
                     F.round("avg_columns", 4).alias("avg_columns"))


def index_distributions(spark, folder):
    tables = profiling.table_metadata(corpus.profiles(spark, folder))
    return catalog.distributions(tables, ["domain", "complexity_level", "size_class"])


def index_upsert(spark, folder):
    """Orders as index entries by customer: the latest one stays."""
    orders = read(spark, folder, "orders").select(
        F.format_string("table_%04d", "o_custkey").alias("table_id"),
        F.concat(F.lit("order "), col("o_orderkey").cast("string")).alias("title"),
        F.struct("o_orderdate", "o_orderkey").alias("added_at"), "o_orderstatus")
    old = orders.filter("o_orderstatus = 'F'").drop("o_orderstatus")
    new = orders.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    return catalog.upsert(old, new).select("table_id", "title")


def table_summaries(spark, folder):
    """Stored tables with title and shape; one of them has no metadata."""
    base = scratch_path(spark, "tables")
    for i, table in enumerate(["customer", "supplier"]):
        df = read(spark, folder, table)
        meta = profiling.shape(df).select(F.lit(table).alias("title"), "row_count", "column_count")
        sinks.write_bundle(base, f"table_{i + 1:04d}", df, meta=meta if i == 0 else None)
    meta = readers.read_documents(spark, f"{base}/*/meta.json", schemas.META)
    df = catalog.table_summaries(
        readers.existing_tables(spark, base), meta, readers.file_sizes(spark, base))
    return df.select("table_id", "title", "row_count", "column_count",
                     (col("table_bytes") > 0).alias("has_table"), (col("meta_bytes") > 0).alias("has_meta"),
                     (col("raw_bytes") > 0).alias("has_raw"))


def _with_quality(spark, folder):
    meta = profiling.table_metadata(corpus.profiles(spark, folder))
    quality = cleaning.clean_corpus(
        corpus.rows(spark, folder), corpus.headers(spark),
        cleaning.Policy(max_rows=None, max_entities=None)).report
    return catalog.with_quality(meta, quality)


def table_quality(spark, folder):
    """Metadata next to the cleaning results of the whole corpus."""
    df = _with_quality(spark, folder)
    return df.select("table_id", "row_count", "column_count", "rows_removed", "columns_removed",
                     F.round("data_completeness", 6).alias("data_completeness"),
                     "numeric_columns_count", F.round("numeric_ratio", 6).alias("numeric_ratio"),
                     "size_class")


def table_report(spark, folder):
    df = catalog.table_report(_with_quality(spark, folder))
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else col(c) for c, t in df.dtypes])


def table_percentages(spark, folder):
    tables = profiling.table_metadata(corpus.profiles(spark, folder))
    df = catalog.percentages(tables, "complexity_level", ["low", "medium", "high"])
    return df.withColumn("percent", F.round("percent", 4))


def numeric_ratio_by_domain(spark, folder):
    from tableworks.operators import stats
    df = stats.boxplot(profiling.table_metadata(corpus.profiles(spark, folder)), ["domain"], "numeric_ratio")
    return df.select("domain", "count", "outliers", *[
        F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


def row_count_histogram(spark, folder):
    from tableworks.operators import stats
    df = stats.histogram(corpus.profiles(spark, folder), "row_count", 20)
    return df.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "count")


QUERIES = {f.__name__: f for f in [
    load_table, bundle_documents, csv_round_trip, csv_with_schema, scan_datasets, check_structure,
    manifests, corpus_csv, csv_cells, corpus_store, incremental_skip, assign_ids, append_log, domain_index,
    index_statistics, index_distributions, index_upsert, table_summaries, table_quality,
    table_report, table_percentages, numeric_ratio_by_domain, row_count_histogram,
]}

_GAPS = """(select c_custkey, c_name, case when c_acctbal > 0 then c_acctbal end as c_acctbal,
  nullif(c_mktsegment, 'MACHINERY') as c_mktsegment from customer)"""


def _column(table_id, pos, name, table, kind):
    numbers = "0" if kind == "object" else "count(*)"
    return f"""select '{table_id}' as table_id, {pos} as col_pos, '{name}' as column_name,
      count(*) as n_rows, 0::bigint as n_nulls, {numbers}::bigint as n_numbers, '{kind}' as dtype from {table}"""


def _present(column):
    """A cell as text, null for the tokens that a CSV reader takes as missing."""
    tokens = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
    return f"case when {column}::varchar not in ({tokens}) then {column}::varchar end"


_CSV_COLUMNS = {
    "customer": [("c_custkey", "int64"), ("c_name", "object"), ("c_nationkey", "int64"),
                 ("c_acctbal", "float64"), ("c_mktsegment", "object")],
    "supplier": [("s_suppkey", "int64"), ("s_name", "object"), ("s_nationkey", "int64"),
                 ("s_acctbal", "float64")],
    "part": [("p_partkey", "int64"), ("p_name", "object"), ("p_brand", "object"), ("p_type", "object"),
             ("p_size", "int64"), ("p_retailprice", "float64")],
    "region": [("r_regionkey", "int64"), ("r_name", "object")],
    "nation": [("n_nationkey", "int64"), ("n_name", "object"), ("n_regionkey", "int64")],
}


def _quality_sql():
    """Cleaning result per table of the corpus, written out from the column expressions."""
    parts = []
    for table_id, (source, order, spec) in {
            t: (s[0], s[2], s[3]) for t, s in corpus.CORPUS.items()}.items():
        live = [(n, e, k) for n, e, k in spec if k != "none"]
        numbers = sum(k in ("int", "float") for _, _, k in live)
        ids = [e for n, e, _ in live if n in ("Entity", "Country", "Region")]
        where = "where " + " or ".join(f"({e}) is not null" for e in ids) if ids else ""
        cells = ", ".join(f'{e} as "{n}"' for n, e, _ in live)
        present = " + ".join(f'count("{n}")' for n, _, _ in live)
        if len(live) < 3:
            parts.append(f"""select '{table_id}' as table_id, count(*) as rows_removed,
              {len(spec)}::bigint as columns_removed, 0.0::double as data_completeness,
              0::bigint as numeric_columns_count from {source}""")
            continue
        parts.append(f"""select '{table_id}' as table_id,
          (select count(*) from {source}) - count(*) as rows_removed,
          {len(spec) - len(live)}::bigint as columns_removed,
          ({present}) / (count(*) * {len(live)}) as data_completeness,
          {numbers}::bigint as numeric_columns_count
          from (select distinct {cells} from {source} {where})""")
    return "(" + " union all ".join(parts) + ")"


_QUALITY = f"""(select m.* exclude (numeric_ratio), q.* exclude (table_id),
  q.numeric_columns_count / m.column_count as numeric_ratio
  from {corpus.metadata_sql()} m join {_quality_sql()} q on m.table_id = q.table_id)"""
_MEASURES = catalog.REPORT_MEASURES

SQL = {
    "load_table": f"""select g.*, c.c_nationkey from {_GAPS} g join customer c on c.c_custkey = g.c_custkey""",
    "bundle_documents": " union all ".join(
        f"""select 'table_000{i + 1}' as table_id, '{t}' as title, count(*) as row_count,
          {len(_CSV_COLUMNS[t])}::bigint as column_count, true as success, least(count(*), 1000) as final_rows,
          count(*) - least(count(*), 1000) as rows_removed, 1.0::double as data_completeness from {t}"""
        for i, t in enumerate(["customer", "supplier", "part"])),
    "csv_round_trip": f"select * from {_GAPS}",
    "csv_with_schema": f"""select c_mktsegment, count(c_custkey) as count_c_custkey,
        max(c_acctbal) as max_c_acctbal from {_GAPS} group by 1""",
    "scan_datasets": """select * from (values ('customer_data'), ('part_data'), ('region_data'),
        ('supplier_data')) v(dataset)""",
    "check_structure": """select * from (values ('customer_data', true, null),
        ('part_data', false, 'manifest is not an object'), ('region_data', false, 'too few columns'),
        ('supplier_data', true, null)) v(dataset, accepted, reason)""",
    "manifests": """select * from (values ('customer_data', 'The customer table'),
        ('region_data', 'The region table'), ('supplier_data', 'The supplier table')) v(dataset, title)""",
    "corpus_csv": " union all ".join(
        _column(f"{t}_data", i, n, t, k) for t, cs in _CSV_COLUMNS.items() for i, (n, k) in enumerate(cs)),
    "csv_cells": " union all ".join(
        f"select '{t}_data' as dataset, {', '.join(f'{_present(c)} as c{i}' for i, c in enumerate([*cs, 'null'][:5]))}, null::varchar as surplus from {t}"
        for t, cs in _WRITTEN.items()) + """
        union all select 'nation_data', n_nationkey::varchar, n_name, null, null, null,
          case when n_nationkey % 3 = 0 then 'more/' || n_regionkey end from nation""",
    "corpus_store": " union all ".join(
        f"select '{t}' as table_id, count(*) as n, {len(s[3])} as width from {s[0]}"
        for t, s in corpus.CORPUS.items()),
    "incremental_skip": """select regexp_extract(c_name, '#(.*)', 1) as dataset from customer
        where dataset not in (select regexp_extract(s_name, '#(.*)', 1) from supplier) order by 1 limit 100""",
    "assign_ids": """select c_name, printf('table_%04d', 129 + row_number() over (order by c_name)) as table_id
        from customer""",
    "append_log": "select event_id, event_type, value from events",
    "domain_index": f"""select domain, row_number() over (partition by domain order by title, table_id) as position,
        table_id, title, has_time_series, row_count, column_count from {corpus.metadata_sql()}""",
    "index_statistics": f"""select count(*) + 1 as total_tables, round(sum(row_count) / (count(*) + 1), 4) as avg_rows,
        round(sum(column_count) / (count(*) + 1), 4) as avg_columns from {corpus.tables_sql()}""",
    "index_distributions": f"""with m as (select domain, complexity_level, size_class from {corpus.metadata_sql()})
        select 'domain' as dimension, domain as value, count(*) as count from m group by 2
        union all select 'complexity_level', complexity_level, count(*) from m group by 2
        union all select 'size_class', size_class, count(*) from m group by 2""",
    "index_upsert": """select printf('table_%04d', o_custkey) as table_id,
        'order ' || arg_max(o_orderkey, [epoch_us(o_orderdate), o_orderkey]) as title from orders group by 1""",
    "table_summaries": """select 'table_0001' as table_id, 'customer' as title, count(*) as row_count,
          5::bigint as column_count, true as has_table, true as has_meta, false as has_raw from customer
        union all select 'table_0002', 'Unknown', null, null, true, false, false""",
    "table_quality": f"""select table_id, row_count, column_count, rows_removed, columns_removed,
        round(data_completeness, 6) as data_completeness, numeric_columns_count,
        round(numeric_ratio, 6) as numeric_ratio, size_class from {_QUALITY}""",
    "table_report": "select count(*) as total_tables, "
        + ", ".join(f"round(avg({m}), 4) as mean_{m}" for m in _MEASURES) + ", "
        + ", ".join(f"round(stddev_samp({m}), 4) as std_{m}" for m in _MEASURES)
        + f""", count(*) filter (has_time_series) as time_series_tables,
        round(avg(cast(has_time_series as int)), 4) as time_series_share,
        round(corr(row_count, data_completeness), 4) as corr_rows_completeness,
        round(corr(column_count, numeric_ratio), 4) as corr_columns_numeric_ratio from {_QUALITY}""",
    "table_percentages": f"""with m as (select complexity_level as class, count(*) as count
          from {corpus.metadata_sql()} group by 1)
        select c.class, coalesce(m.count, 0) as count,
          round(coalesce(m.count, 0) * 100.0 / {len(corpus.CORPUS)}, 4) as percent
        from (values ('low'), ('medium'), ('high')) c(class) left join m on m.class = c.class""",
    "numeric_ratio_by_domain": f"""with t as (select domain, numeric_ratio as v from {corpus.metadata_sql()}),
        q as (select domain, quantile_cont(v, 0.25) as q1, median(v) as median,
          quantile_cont(v, 0.75) as q3 from t group by 1),
        d as (select t.domain, v, q1, median, q3,
          v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from t join q on t.domain = q.domain)
        select domain, count(*) as count, count(*) filter (not inside) as outliers,
          round(any_value(q1), 4) as q1, round(any_value(median), 4) as median,
          round(any_value(q3), 4) as q3, round(min(v) filter (inside), 4) as whisker_low,
          round(max(v) filter (inside), 4) as whisker_high from d group by 1""",
    "row_count_histogram": f"""with v as (select cast(row_count as double) as v from {corpus.tables_sql()}),
        b as (select min(v) as lo, max(v) as hi from v),
        c as (select least(cast(floor((v - lo) / ((hi - lo) / 20)) as int), 19) as bin, count(*) as count
          from v, b group by 1)
        select cast(g.bin as int) as bin, round(lo + (hi - lo) / 20 * g.bin, 4) as low,
          round(lo + (hi - lo) / 20 * (g.bin + 1), 4) as high, coalesce(c.count, 0) as count
        from b, range(0, 20) g(bin) left join c on c.bin = g.bin""",
}
