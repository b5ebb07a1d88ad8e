"""Counts, descriptions, shares, histograms, caps and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import read
from tableworks.functions.columns import col
from tableworks.operators import relational as rel
from tableworks.operators import sampling, stats


def value_counts(spark, folder):
    df = read(spark, folder, "lineitem").withColumn("l_returnflag", F.expr("nullif(l_returnflag, 'N')"))
    return stats.value_counts(df, "l_returnflag")


def distinct_count(spark, folder):
    return stats.distinct_count(read(spark, folder, "lineitem"), "l_partkey")


def describe_cols(spark, folder):
    df = stats.describe(read(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return df.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max")])


def describe_by_group(spark, folder):
    df = stats.describe(read(spark, folder, "orders"), ["o_totalprice"], ["o_orderpriority"])
    return df.select("o_orderpriority", "column", "count",
                     *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max")])


def corr_pair(spark, folder):
    df = stats.correlation(read(spark, folder, "lineitem"), [("l_quantity", "l_extendedprice"),
                                                             ("l_discount", "l_tax")])
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


def crosstab(spark, folder):
    return stats.crosstab(read(spark, folder, "lineitem"), "l_returnflag", "l_linenumber",
                          [1, 2, 3, 4, 5, 6, 7, 8]).select(
        "l_returnflag", *[col(str(i)).alias(f"line_{i}") for i in range(1, 9)])


def success_rate(spark, folder):
    df = read(spark, folder, "orders").withColumn(
        "ok", F.expr("case o_orderstatus when 'F' then true when 'O' then false end"))
    return stats.rate_by(df, ["o_orderpriority"], col("ok")).withColumn(
        "success_rate", F.round("success_rate", 6))


def boolean_share(spark, folder):
    df = read(spark, folder, "labels").select((col("quality") == 1).alias("good"))
    return df.agg(F.count_if("good").alias("n_good"),
                  F.round(F.avg(col("good").cast("int")), 6).alias("share_good"))


def share_minor(spark, folder):
    counts = read(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("count"))
    sizes = counts.groupBy(col("count").alias("orders_per_customer")).agg(F.count(F.lit(1)).alias("count"))
    return stats.share_of_total(sizes).withColumn("share", F.round("share", 6))


def _rounded_bins(df):
    return df.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "count")


def time_hist(spark, folder):
    """Half the number of values as bins, between 10 and 30."""
    return _rounded_bins(stats.histogram(read(spark, folder, "events"), "value"))


def histogram20(spark, folder):
    return _rounded_bins(stats.histogram(read(spark, folder, "documents"), "n_chars", 20))


def boxplot_by(spark, folder):
    df = stats.boxplot(read(spark, folder, "documents"), ["lang"], "n_chars")
    return df.select("lang", "count", "outliers", *[
        F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


def head_per_table(spark, folder):
    df = sampling.head(read(spark, folder, "events"), ["user_id"], ["ts", "event_id"], 5)
    return rel.select(df, "user_id", "event_id", "value")


def head_tail_balanced(spark, folder):
    df = sampling.head_and_tail(read(spark, folder, "events"), ["user_id"], ["ts", "event_id"], 5)
    return rel.select(df, "user_id", "event_id")


def head_tail_small_groups(spark, folder):
    """Most conversations are shorter than the preview and come back whole."""
    df = sampling.head_and_tail(read(spark, folder, "conversations"), ["conv_id"], ["turn"], 4)
    return rel.select(df, "conv_id", "turn", "role")


def cap_rows(spark, folder):
    return rel.select(sampling.cap_rows(read(spark, folder, "orders"), ["o_orderkey"], 1000),
                      "o_orderkey", "o_custkey")


def top_categories(spark, folder):
    return sampling.top_categories(read(spark, folder, "lineitem"), "l_partkey", 50)


def sample_seeded(spark, folder):
    return rel.select(sampling.sample(read(spark, folder, "events"), ["event_id"], 200, 42),
                      "event_id", "user_id", "value")


def sample_seeded_per_table(spark, folder):
    return rel.select(sampling.sample_per_group(read(spark, folder, "events"), ["event_type"],
                                                ["event_id"], 25, 42), "event_type", "event_id")


def shuffle_seeded(spark, folder):
    """The shuffled work list, numbered in its new order."""
    from tableworks.operators.ordered import positions
    keyed = sampling.shuffle(read(spark, folder, "documents").select("doc_id"), ["doc_id"], 7)
    return positions(keyed, ["shuffle_key", "doc_id"]).select("doc_id", "position")


QUERIES = {f.__name__: f for f in [
    value_counts, distinct_count, describe_cols, describe_by_group, corr_pair, crosstab,
    success_rate, boolean_share, share_minor, time_hist, histogram20, boxplot_by, head_per_table,
    head_tail_balanced, head_tail_small_groups, cap_rows, top_categories, sample_seeded,
    sample_seeded_per_table, shuffle_seeded,
]}


def _describe(column, table, by=""):
    prefix = f"{by}, " if by else ""
    return f"""select {prefix}'{column}' as "column", count({column}) as count,
      round(avg({column}), 4) as mean, round(median({column}), 4) as median,
      round(stddev_samp({column}), 4) as std, round(min({column}), 4) as min,
      round(max({column}), 4) as max from {table} {f'group by {by}' if by else ''}"""


def _histogram(column, table, bins):
    return f"""with v as (select cast({column} as double) as v from {table} where {column} is not null),
      b as (select min(v) as lo, max(v) as hi, {bins} as n from v),
      c as (select least(cast(floor((v - lo) / ((hi - lo) / n)) as int), cast(n as int) - 1) as bin,
        count(*) as count from v, b group by 1)
      select cast(g.bin as int) as bin, round(lo + (hi - lo) / n * g.bin, 4) as low,
        round(lo + (hi - lo) / n * (g.bin + 1), 4) as high, coalesce(c.count, 0) as count
      from b, range(0, 30) g(bin) left join c on c.bin = g.bin where g.bin < n"""


SQL = {
    "value_counts": """select l_returnflag, count(*) as count from lineitem
        where l_returnflag <> 'N' group by 1""",
    "distinct_count": "select count(distinct l_partkey) as distinct_l_partkey from lineitem",
    "describe_cols": " union all ".join(
        _describe(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "describe_by_group": _describe("o_totalprice", "orders", "o_orderpriority"),
    "corr_pair": """select round(corr(l_quantity, l_extendedprice), 6) as corr_l_quantity_l_extendedprice,
        round(corr(l_discount, l_tax), 6) as corr_l_discount_l_tax from lineitem""",
    "crosstab": "select l_returnflag, " + ", ".join(
        f"count(*) filter (l_linenumber = {i}) as line_{i}" for i in range(1, 9)
    ) + " from lineitem group by 1",
    "success_rate": """select o_orderpriority, count(*) as count,
        round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) as success_rate
        from orders group by 1""",
    "boolean_share": """select count(*) filter (quality = 1) as n_good,
        round(avg(case when quality = 1 then 1 else 0 end), 6) as share_good from labels""",
    "share_minor": """with s as (select c as orders_per_customer, count(*) as count
        from (select count(*) as c from orders group by o_custkey) group by 1),
        t as (select sum(count) as n from s)
        select orders_per_customer, count, round(count / n, 6) as share,
        case when count / n < 0.01 then 'minor' else 'main' end as share_class from s, t""",
    "time_hist": _histogram("value", "events", "greatest(10, least(30, count(*) // 2))"),
    "histogram20": _histogram("n_chars", "documents", "20"),
    "boxplot_by": """with q as (select lang, quantile_cont(n_chars, 0.25) as q1, median(n_chars) as median,
          quantile_cont(n_chars, 0.75) as q3 from documents group by 1),
        d as (select d.lang, cast(n_chars as double) as v, q1, median, q3,
          n_chars between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
          from documents d join q on d.lang = q.lang)
        select lang, count(*) as count, count(*) filter (not inside) as outliers,
          round(any_value(q1), 4) as q1, round(any_value(median), 4) as median,
          round(any_value(q3), 4) as q3, min(v) filter (inside) as whisker_low,
          max(v) filter (inside) as whisker_high from d group by 1""",
    "head_per_table": """select user_id, event_id, value from events
        qualify row_number() over (partition by user_id order by ts, event_id) <= 5""",
    "head_tail_balanced": """select user_id, event_id from events
        qualify row_number() over (partition by user_id order by ts, event_id) <= 2
        or row_number() over (partition by user_id order by ts desc, event_id desc) <= 3""",
    "head_tail_small_groups": """select conv_id, turn, role from conversations
        qualify row_number() over (partition by conv_id order by turn) <= 2
        or row_number() over (partition by conv_id order by turn desc) <= 2""",
    "cap_rows": "select o_orderkey, o_custkey from orders order by o_orderkey limit 1000",
    "top_categories": """select l_partkey, count(*) as count from lineitem group by 1
        order by 2 desc, 1 limit 50""",
    "sample_seeded": """select event_id, user_id, value from events
        order by md5('42:' || event_id), event_id limit 200""",
    "sample_seeded_per_table": """select event_type, event_id from events qualify row_number()
        over (partition by event_type order by md5('42:' || event_id), event_id) <= 25""",
    "shuffle_seeded": """select doc_id, row_number() over (order by md5('7:' || doc_id), doc_id) as position
        from documents""",
}
