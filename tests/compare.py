"""Run registered queries next to their DuckDB SQL: ``python tests/compare.py [folder] [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("tableworks-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .getOrCreate()
    )


def connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return bool(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def normal_rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(
        (tuple(_cell(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r)
    )


def difference(spark, con, folder, query, sql) -> str | None:
    """None when both engines agree on names, number of rows and values."""
    df = query(spark, folder)
    names, got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    other, want = normal_rows([d[0] for d in rel.description], rel.fetchall())
    if names != other:
        return f"columns {names} != {other}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"values {g} != {w}"
    return None


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = difference(spark, con, folder, query, sql[name])
            else:
                n = query(spark, folder).count()
                problem = None
                print(f"     {name}: rows only, {n}")
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad of {len(queries)}; sql without query: {sorted(set(sql) - set(queries))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
