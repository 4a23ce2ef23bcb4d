"""Compare registered queries with their SQL: ``python tests/parity.py [-d DIR] [NAME...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings docs provisions citations"
    " obs_history semantic_chunks embedding_cache eval_items"
).split()


def duck(directory: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{directory}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, directory, query, sql) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, directory)
    left = rows_of(df.columns, df.collect())
    ran = con.execute(sql)
    right = rows_of([c[0] for c in ran.description], ran.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} and {right[0]}"
    if left[1] != right[1]:
        a, b = set(left[1]), set(right[1])
        return f"{len(left[1])} and {len(right[1])} rows; only Spark {sorted(a - b, key=repr)[:3]}; only SQL {sorted(b - a, key=repr)[:3]}"
    return ""


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    directory = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        directory, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", "/tmp/warehouse").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(directory), entry.queries(), entry.oracle_sql()
    for name in args or queries:
        began = time.time()
        try:
            said = compare(spark, con, directory, queries[name], oracles[name]) if name in oracles else f"no SQL, {queries[name](spark, directory).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
