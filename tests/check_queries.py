"""Compare every registered query with its SQL counterpart: ``python tests/check_queries.py [sf_dir] [names...]``."""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    """Rows as a sorted list of tuples, columns by name."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(row[k] for k in order) for row in rows), key=repr)


def compare(spark, con, sf_dir, name):
    """``(seconds, rows, problem)`` of one query against its SQL."""
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return seconds, len(got), None if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return seconds, len(got), f"columns {df.columns} against {columns}"
    a, b = canonical(got, df.columns), canonical(want, columns)
    if a != b:
        extra = [row for row in a if row not in set(b)][:3]
        missing = [row for row in b if row not in set(a)][:3]
        return seconds, len(got), f"{len(a)} against {len(b)} rows; extra {extra}; missing {missing}"
    return seconds, len(got), None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-state-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            seconds, rows, problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            seconds, rows, problem = 0.0, 0, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        checked = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {checked:4} {seconds:7.2f}s {rows:8} {name} {problem or ''}", flush=True)
    print(f"{bad} of {len(names)} differ")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
