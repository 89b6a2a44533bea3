"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark, con, sf_dir, query, sql):
    """None if both give the same rows, else a short description."""
    df = query(spark, sf_dir)
    ours = table(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = table(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if ours != theirs:
        a, b = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
        return f"{len(ours)} rows against {len(theirs)}; {len(a)} only ours {a[:3]}; {len(b)} only theirs {b[:3]}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), contract.queries(), contract.oracle_sql()
    for name in names or sql:
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, queries[name], sql[name])
        except Exception as error:
            found = f"error {str(error)[:500]}"
        print(f"{name:30s} {time.time() - start:7.2f}s {found or 'same'}", flush=True)


if __name__ == "__main__":
    main()
