"""Scans, predicates, derived columns, joins, grouping, order and limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import read
from tableworks.operators import relational as rel
from tableworks.operators import stats
from tableworks.functions.columns import col


def _lineitem_with_gaps(spark, folder):
    """lineitem with nulls: flag N and quantities above 45 are blanked."""
    return read(spark, folder, "lineitem").withColumns({
        "l_returnflag": F.expr("nullif(l_returnflag, 'N')"),
        "l_quantity": F.expr("case when l_quantity <= 45 then l_quantity end"),
    })


_GAPS = """(select * replace (nullif(l_returnflag, 'N') as l_returnflag,
  case when l_quantity <= 45 then l_quantity end as l_quantity) from lineitem)"""


def flagship(spark, folder):
    """Filter, join, derive, group, order, limit over lineitem and orders."""
    lines = rel.filter_all(read(spark, folder, "lineitem"), [
        ("l_quantity", ">=", 10.0), ("l_returnflag", "==", "R"),
    ])
    lines = rel.select(lines, "l_orderkey", "l_extendedprice", "l_discount")
    orders = rel.select(
        read(spark, folder, "orders").withColumnRenamed("o_orderkey", "l_orderkey"),
        "l_orderkey", "o_orderpriority",
    )
    # order keys are never null, so plain keys do
    joined = rel.join(lines, orders, on=["l_orderkey"], nulls="sql")
    factor = rel.derive(joined, "factor", 1, "-", "l_discount")
    net = rel.derive(factor, "net", "l_extendedprice", "*", "factor")
    grouped = rel.group_aggregate(
        net, ["o_orderpriority"], [("sum", "net"), ("mean", "net"), ("count", "net")]
    )
    top = rel.limit(rel.order(grouped, "sum_net", ascending=False), 10)
    return top.select(
        "o_orderpriority", F.round("sum_net", 2).alias("sum_net"),
        F.round("mean_net", 4).alias("mean_net"), "count_net",
    )


def select_cols(spark, folder):
    return rel.select(read(spark, folder, "lineitem"), "l_shipdate", "l_orderkey", "l_linenumber") \
        .withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


def filter_eq(spark, folder):
    df = rel.filter_rows(read(spark, folder, "orders"), "o_orderstatus", "==", "F")
    return rel.select(df, "o_orderkey", "o_totalprice")


def filter_order_ops(spark, folder):
    df = read(spark, folder, "lineitem")
    for column, op, value in [("l_quantity", ">", 5), ("l_quantity", "<=", 40),
                              ("l_discount", "<", 0.09), ("l_tax", ">=", 0.01)]:
        df = rel.filter_rows(df, column, op, value)
    return df.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


def filter_ne_nulls(spark, folder):
    df = rel.filter_rows(_lineitem_with_gaps(spark, folder), "l_returnflag", "!=", "R")
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def filter_type_mismatch(spark, folder):
    df = read(spark, folder, "part")
    equal = rel.filter_rows(df, "p_size", "==", "7").agg(F.count(F.lit(1)).alias("equal_rows"))
    other = rel.filter_rows(df, "p_size", "!=", "7").agg(F.count(F.lit(1)).alias("other_rows"))
    return equal.select("equal_rows", other.scalar().alias("other_rows"))


def filter_all(spark, folder):
    df = rel.filter_all(read(spark, folder, "lineitem"), [
        ("l_quantity", ">=", 10.0), ("l_returnflag", "==", "R"), ("l_linestatus", "!=", "O"),
    ])
    return rel.select(df, "l_orderkey", "l_partkey", "l_quantity")


def filter_any(spark, folder):
    df = rel.filter_any(read(spark, folder, "part"), [
        ("p_size", ">", 45), ("p_brand", "==", "Brand#3"), ("p_type", "==", "PROMO"),
    ])
    return rel.select(df, "p_partkey", "p_name")


def filter_any_one_column(spark, folder):
    df = rel.filter_any(read(spark, folder, "orders"), [
        ("o_orderpriority", "==", "1-URGENT"), ("o_orderpriority", "==", "2-HIGH"),
    ])
    return rel.select(df, "o_orderkey", "o_orderpriority")


def saved_tables(spark, folder):
    rel.save(rel.filter_rows(read(spark, folder, "customer"), "c_acctbal", "<", 0), "tw_debtors")
    rel.save(read(spark, folder, "nation"), "tw_nations")
    debtors = rel.use(spark, "tw_debtors").withColumnRenamed("c_nationkey", "n_nationkey")
    joined = rel.join(debtors, rel.use(spark, "tw_nations"), ["n_nationkey"])
    return rel.group_aggregate(joined, ["n_name"], [("count", "c_custkey")])


def derive_arith(spark, folder):
    df = read(spark, folder, "lineitem")
    df = rel.derive(df, "plus", "l_extendedprice", "+", "l_quantity")
    df = rel.derive(df, "minus", "l_linenumber", "-", 1)
    df = rel.derive(df, "times", "l_extendedprice", "*", "l_discount")
    df = rel.derive(df, "half", "l_quantity", "/", 2)
    df = rel.derive(df, "half", "half", "+", 1)  # an existing name is overwritten
    return df.select("l_orderkey", "l_linenumber", F.round("plus", 2).alias("plus"), "minus",
                     F.round("times", 4).alias("times"), "half")


def derive_div_null(spark, folder):
    df = rel.derive(read(spark, folder, "lineitem"), "ratio", "l_tax", "/", "l_discount")
    return df.select("l_orderkey", "l_partkey", F.round("ratio", 6).alias("ratio"))


def derive_div_ieee(spark, folder):
    df = rel.derive(read(spark, folder, "lineitem"), "ratio", "l_tax", "/", "l_discount",
                    on_zero="ieee")
    kind = F.when(F.isnan("ratio"), "nan").when(col("ratio") == float("inf"), "inf").otherwise("number")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def derive_concat(spark, folder):
    df = _lineitem_with_gaps(spark, folder)
    df = rel.derive(df, "status", "l_returnflag", "+", "l_linestatus")
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def derive_agg_scalar(spark, folder):
    df = read(spark, folder, "part")
    for fn in ("sum", "mean", "max", "min", "count"):
        df = rel.derive_aggregate(df, f"{fn}_price", fn, "p_retailprice")
    df = rel.derive(df, "share", "p_retailprice", "/", "sum_price")
    return df.select("p_partkey", F.round("sum_price", 2).alias("sum_price"),
                     F.round("mean_price", 4).alias("mean_price"), "max_price", "min_price",
                     "count_price", F.round("share", 8).alias("share"))


def _lines(spark, folder):
    return rel.select(
        read(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "key"),
        "key", "l_linenumber", "l_quantity",
    )


def _some_orders(spark, folder):
    df = rel.filter_rows(read(spark, folder, "orders"), "o_orderstatus", "!=", "P")
    return rel.select(df.withColumnRenamed("o_orderkey", "key"), "key", "o_orderpriority")


def join_inner(spark, folder):
    return rel.join(_lines(spark, folder), _some_orders(spark, folder), ["key"])


def join_left(spark, folder):
    return rel.join(_lines(spark, folder), _some_orders(spark, folder), ["key"], "left")


def join_right(spark, folder):
    lines = rel.filter_rows(_lines(spark, folder), "l_quantity", ">", 40)
    return rel.join(lines, _some_orders(spark, folder), ["key"], "right")


def join_outer(spark, folder):
    lines = rel.filter_rows(_lines(spark, folder), "l_quantity", ">", 40)
    return rel.join(lines, _some_orders(spark, folder), ["key"], "outer")


def join_outer_hot(spark, folder):
    """Lines and orders by customer's nation and status; every key is hot, some on one side only."""
    lines = read(spark, folder, "customer").selectExpr("nullif(c_nationkey, 3) as key", "c_custkey as left_row")
    suppliers = read(spark, folder, "supplier").selectExpr(
        "case when s_nationkey % 4 > 0 then s_nationkey end as key", "s_suppkey as right_row").filter("key is null or key > 4")
    return rel.join(lines, suppliers, ["key"], "outer", hot_rows=3)


def _counts_by_nation(spark, folder, table, prefix):
    """Row counts per nation key, where nation keys below 3 are blanked."""
    key = F.expr(f"case when {prefix}_nationkey >= 3 then {prefix}_nationkey end")
    df = read(spark, folder, table).withColumn("nation", key)
    return df.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


def join_null_keys(spark, folder):
    """A null key on the left meets a null key on the right."""
    return rel.join(_counts_by_nation(spark, folder, "customer", "c"),
                    _counts_by_nation(spark, folder, "supplier", "s"), ["nation"], "outer")


def join_overlap_suffix(spark, folder):
    """Both sides have a column n; the result has n_x and n_y."""
    return rel.join(_counts_by_nation(spark, folder, "customer", "c"),
                    _counts_by_nation(spark, folder, "supplier", "s"), ["nation"], "left")


def join_two_keys(spark, folder):
    lines = read(spark, folder, "lineitem").select(
        col("l_partkey").alias("part"), col("l_suppkey").alias("supp"), "l_quantity")
    totals = rel.group_aggregate(lines, ["part", "supp"], [("sum", "l_quantity")])
    return rel.join(lines, totals, ["part", "supp"]).select(
        "part", "supp", "l_quantity", "sum_l_quantity")


def join_ratio(spark, folder):
    """Two measures of one entity and year put against each other."""
    orders = read(spark, folder, "orders").select(
        col("o_orderkey").alias("key"), F.year("o_orderdate").alias("Year"), "o_totalprice",
        col("o_orderpriority").alias("Entity"))
    lines = read(spark, folder, "lineitem").select(
        col("l_orderkey").alias("key"), "l_quantity")
    per_order = rel.group_aggregate(lines, ["key"], [("sum", "l_quantity")])
    both = rel.group_aggregate(rel.join(orders, per_order, ["key"]), ["Entity", "Year"],
                               [("sum", "o_totalprice"), ("sum", "sum_l_quantity")])
    ratio = rel.derive(both, "ratio", "sum_o_totalprice", "/", "sum_sum_l_quantity")
    return ratio.select("Entity", col("Year").cast("long").alias("Year"), F.round("ratio", 4).alias("ratio"))


def arg_max(spark, folder):
    """Filter, order descending, limit 1, select."""
    df = rel.filter_any(read(spark, folder, "customer"), [
        ("c_mktsegment", "==", "BUILDING"), ("c_mktsegment", "==", "MACHINERY"),
    ])
    return rel.select(rel.limit(rel.order(df, "c_acctbal", "c_custkey", ascending=False), 1),
                      "c_custkey", "c_name", "c_acctbal")


def year_difference(spark, folder):
    """Difference of one measure between consecutive years, as a self-join on the year."""
    yearly = read(spark, folder, "orders").select(
        col("o_orderpriority").alias("Entity"), F.year("o_orderdate").alias("Year"), "o_totalprice")
    yearly = rel.group_aggregate(yearly, ["Entity", "Year"], [("sum", "o_totalprice")])
    before = rel.derive(yearly, "Year", "Year", "+", 1)
    both = rel.join(rel.derive(yearly, "Year", "Year", "+", 0), before, ["Entity", "Year"])
    change = rel.derive(both, "change", "sum_o_totalprice_x", "-", "sum_o_totalprice_y")
    return change.select("Entity", "Year", F.round("change", 2).alias("change"))


def existence_test(spark, folder):
    df = rel.filter_all(read(spark, folder, "part"), [("p_size", ">", 49), ("p_type", "==", "PROMO")])
    return df.agg((F.count(F.lit(1)) > 0).alias("found"))


def top_ten_sum(spark, folder):
    """Order, limit 10, sum."""
    top = rel.limit(rel.order(read(spark, folder, "orders"), "o_totalprice", "o_orderkey",
                              ascending=False), 10)
    return rel.group_aggregate(top, [], [("sum", "o_totalprice")]).select(
        F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"))


def semi_top_entities(spark, folder):
    from tableworks.operators.sampling import keep_top_categories
    df = keep_top_categories(read(spark, folder, "orders"), "o_custkey", 300)
    return rel.select(df, "o_orderkey", "o_custkey")


def anti_new_only(spark, folder):
    """Customers that never ordered anything above the average order."""
    big = rel.derive_aggregate(read(spark, folder, "orders"), "mean", "mean", "o_totalprice")
    big = big.filter("o_totalprice > mean").withColumnRenamed("o_custkey", "c_custkey")
    return rel.select(rel.anti(read(spark, folder, "customer"), big, ["c_custkey"]),
                      "c_custkey", "c_name")


def group_agg_multi(spark, folder):
    df = rel.group_aggregate(read(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], [
        ("sum", "l_quantity"), ("mean", "l_extendedprice"), ("max", "l_discount"),
        ("min", "l_tax"), ("count", "l_orderkey"),
    ], ordered=True)
    return df.withColumn("mean_l_extendedprice", F.round("mean_l_extendedprice", 4))


def group_null_key(spark, folder):
    return rel.group_aggregate(_lineitem_with_gaps(spark, folder), ["l_returnflag"],
                               [("count", "l_orderkey"), ("count", "l_quantity")])


def group_sum_null_zero(spark, folder):
    """A group whose values are all null sums to 0 and has a null mean."""
    df = read(spark, folder, "lineitem").withColumn(
        "price", F.expr("case when l_returnflag <> 'A' then l_extendedprice end"))
    return rel.group_aggregate(df, ["l_returnflag"], [("sum", "price"), ("mean", "price"),
                                                      ("max", "price"), ("count", "price")]) \
        .withColumns({"sum_price": F.round("sum_price", 2), "mean_price": F.round("mean_price", 4)})


def agg_global(spark, folder):
    return rel.group_aggregate(read(spark, folder, "events"), [], [
        ("count", "event_id"), ("sum", "value"), ("mean", "value"), ("max", "value"), ("min", "value"),
    ]).withColumns({"sum_value": F.round("sum_value", 2), "mean_value": F.round("mean_value", 4)})


def agg_global_empty(spark, folder):
    df = rel.filter_rows(read(spark, folder, "events"), "event_type", "==", "no such type")
    return rel.group_aggregate(df, [], [("count", "event_id"), ("sum", "value"), ("mean", "value")])


def order_limit_topk(spark, folder):
    df = _lineitem_with_gaps(spark, folder)
    keys = ("l_quantity", "l_extendedprice", "l_orderkey", "l_partkey")
    up = rel.limit(rel.order(df, *keys), 20).withColumn("direction", F.lit("up"))
    down = rel.limit(rel.order(df, *keys, ascending=False), 20).withColumn("direction", F.lit("down"))
    return rel.select(up.unionByName(down), "direction", *keys)


QUERIES = {f.__name__: f for f in [
    flagship, select_cols, filter_eq, filter_order_ops, filter_ne_nulls, filter_type_mismatch,
    filter_all, filter_any, filter_any_one_column, saved_tables, derive_arith, derive_div_null,
    derive_div_ieee, derive_concat, derive_agg_scalar, join_inner, join_left, join_right,
    join_outer, join_outer_hot, join_null_keys, join_overlap_suffix, join_two_keys, join_ratio, arg_max,
    year_difference, existence_test, top_ten_sum, semi_top_entities, anti_new_only,
    group_agg_multi, group_null_key, group_sum_null_zero, agg_global, agg_global_empty,
    order_limit_topk,
]}

_ORDERS = "(select o_orderkey as key, o_orderpriority from orders where o_orderstatus is distinct from 'P')"
_LINES = "(select l_orderkey as key, l_linenumber, l_quantity from lineitem)"
_BIG = f"(select * from {_LINES} where l_quantity > 40)"
_CUST = """(select case when c_nationkey >= 3 then c_nationkey end as nation, count(*) as n
  from customer group by 1)"""
_SUPP = """(select case when s_nationkey >= 3 then s_nationkey end as nation, count(*) as n
  from supplier group by 1)"""

SQL = {
    "flagship": """select o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_net,
        round(avg(l_extendedprice * (1 - l_discount)), 4) as mean_net, count(*) as count_net
        from lineitem join orders on l_orderkey = o_orderkey
        where l_quantity >= 10 and l_returnflag = 'R'
        group by 1 order by 2 desc limit 10""",
    "select_cols": """select strftime(l_shipdate, '%Y-%m-%d') as l_shipdate, l_orderkey, l_linenumber
        from lineitem""",
    "filter_eq": "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'",
    "filter_order_ops": """select l_linestatus, count(*) as n, sum(l_quantity) as qty from lineitem
        where l_quantity > 5 and l_quantity <= 40 and l_discount < 0.09 and l_tax >= 0.01 group by 1""",
    "filter_ne_nulls": f"""select l_returnflag, count(*) as n from {_GAPS}
        where l_returnflag is distinct from 'R' group by 1""",
    "filter_type_mismatch": "select cast(0 as bigint) as equal_rows, count(*) as other_rows from part",
    "filter_all": """select l_orderkey, l_partkey, l_quantity from lineitem
        where l_quantity >= 10 and l_returnflag = 'R' and l_linestatus <> 'O'""",
    "filter_any": """select p_partkey, p_name from part
        where p_size > 45 or p_brand = 'Brand#3' or p_type = 'PROMO'""",
    "filter_any_one_column": """select o_orderkey, o_orderpriority from orders
        where o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "saved_tables": """select n_name, count(c_custkey) as count_c_custkey from customer
        join nation on c_nationkey = n_nationkey where c_acctbal < 0 group by 1""",
    "derive_arith": """select l_orderkey, l_linenumber, round(l_extendedprice + l_quantity, 2) as plus,
        cast(l_linenumber as bigint) - 1 as minus, round(l_extendedprice * l_discount, 4) as times,
        l_quantity / 2 + 1 as half from lineitem""",
    "derive_div_null": """select l_orderkey, l_partkey,
        round(case when l_discount <> 0 then l_tax / l_discount end, 6) as ratio from lineitem""",
    "derive_div_ieee": """select case when l_discount <> 0 then 'number' when l_tax = 0 then 'nan'
        else 'inf' end as kind, count(*) as n from lineitem group by 1""",
    "derive_concat": f"""select l_returnflag || l_linestatus as status, count(*) as n
        from {_GAPS} group by 1""",
    "derive_agg_scalar": """select p_partkey, round(s, 2) as sum_price, round(a, 4) as mean_price,
        hi as max_price, lo as min_price, n as count_price, round(p_retailprice / s, 8) as share
        from part, (select sum(p_retailprice) as s, avg(p_retailprice) as a, max(p_retailprice) as hi,
          min(p_retailprice) as lo, count(p_retailprice) as n from part)""",
    "join_inner": f"select l.key, l_linenumber, l_quantity, o_orderpriority from {_LINES} l join {_ORDERS} o on l.key = o.key",
    "join_left": f"select l.key, l_linenumber, l_quantity, o_orderpriority from {_LINES} l left join {_ORDERS} o on l.key = o.key",
    "join_right": f"select o.key, l_linenumber, l_quantity, o_orderpriority from {_BIG} l right join {_ORDERS} o on l.key = o.key",
    "join_outer": f"""select coalesce(l.key, o.key) as key, l_linenumber, l_quantity, o_orderpriority
        from {_BIG} l full join {_ORDERS} o on l.key = o.key""",
    "join_outer_hot": """select coalesce(c.key, s.key) as key, left_row, right_row
        from (select nullif(c_nationkey, 3) as key, c_custkey as left_row from customer) c full join
          (select case when s_nationkey % 4 > 0 then s_nationkey end as key, s_suppkey as right_row from supplier
            where s_nationkey % 4 = 0 or s_nationkey > 4) s on coalesce(c.key, -1) = coalesce(s.key, -1)""",
    "join_null_keys": f"""select coalesce(c.nation, s.nation) as nation, c.n as n_x, s.n as n_y
        from {_CUST} c full join {_SUPP} s on coalesce(c.nation, -1) = coalesce(s.nation, -1)""",
    "join_overlap_suffix": f"""select c.nation, c.n as n_x, s.n as n_y
        from {_CUST} c left join {_SUPP} s on c.nation is not distinct from s.nation""",
    "join_two_keys": """select l_partkey as part, l_suppkey as supp, l_quantity,
        sum(l_quantity) over (partition by l_partkey, l_suppkey) as sum_l_quantity from lineitem""",
    "join_ratio": """select o_orderpriority as "Entity", cast(year(o_orderdate) as bigint) as "Year",
        round(sum(o_totalprice) / sum(q), 4) as ratio from orders join
        (select l_orderkey, sum(l_quantity) as q from lineitem group by 1) on l_orderkey = o_orderkey
        group by 1, 2""",
    "arg_max": """select c_custkey, c_name, c_acctbal from customer
        where c_mktsegment in ('BUILDING', 'MACHINERY') order by c_acctbal desc, c_custkey desc limit 1""",
    "year_difference": """with y as (select o_orderpriority as e, cast(year(o_orderdate) as bigint) as y,
        sum(o_totalprice) as v from orders group by 1, 2)
        select a.e as "Entity", a.y as "Year", round(a.v - b.v, 2) as change
        from y a join y b on a.e = b.e and a.y = b.y + 1""",
    "existence_test": "select count(*) > 0 as found from part where p_size > 49 and p_type = 'PROMO'",
    "top_ten_sum": """select round(sum(o_totalprice), 2) as sum_o_totalprice from
        (select o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 10)""",
    "semi_top_entities": """select o_orderkey, o_custkey from orders where o_custkey in
        (select o_custkey from orders group by 1 order by count(*) desc, o_custkey limit 300)""",
    "anti_new_only": """select c_custkey, c_name from customer where c_custkey not in
        (select o_custkey from orders where o_totalprice > (select avg(o_totalprice) from orders))""",
    "group_agg_multi": """select l_returnflag, l_linestatus, sum(l_quantity) as sum_l_quantity,
        round(avg(l_extendedprice), 4) as mean_l_extendedprice, max(l_discount) as max_l_discount,
        min(l_tax) as min_l_tax, count(l_orderkey) as count_l_orderkey from lineitem group by 1, 2""",
    "group_null_key": f"""select l_returnflag, count(l_orderkey) as count_l_orderkey,
        count(l_quantity) as count_l_quantity from {_GAPS} group by 1""",
    "group_sum_null_zero": """select l_returnflag, coalesce(round(sum(price), 2), 0) as sum_price,
        round(avg(price), 4) as mean_price, max(price) as max_price, count(price) as count_price
        from (select l_returnflag, case when l_returnflag <> 'A' then l_extendedprice end as price
        from lineitem) group by 1""",
    "agg_global": """select count(event_id) as count_event_id, round(sum(value), 2) as sum_value,
        round(avg(value), 4) as mean_value, max(value) as max_value, min(value) as min_value from events""",
    "agg_global_empty": """select count(event_id) as count_event_id, coalesce(sum(value), 0) as sum_value,
        avg(value) as mean_value from events where event_type = 'no such type'""",
    "order_limit_topk": f"""(select 'up' as direction, l_quantity, l_extendedprice, l_orderkey, l_partkey
        from {_GAPS} order by 2 asc nulls last, 3, 4, 5 limit 20) union all
        (select 'down', l_quantity, l_extendedprice, l_orderkey, l_partkey
        from {_GAPS} order by 2 desc nulls last, 3 desc, 4 desc, 5 desc limit 20)""",
}
