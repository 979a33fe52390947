"""Compare registered queries with their SQL in DuckDB.

Usage: python tools/check.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    return repr(value) if isinstance(value, float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in data)


def compare(spark, con, plan, sql, folder):
    frame = plan(spark, folder)
    left = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return frame.columns, left, None, None
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    right = rows(names, done.fetchall())
    return frame.columns, left, names, right


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    from importlib import import_module

    from tidemark import plans
    from tidemark.plans.registry import PLANS, SQL

    for module in plans.REGISTERING:
        import_module(f"tidemark.plans.{module}")
    spark, con = session(), connect(folder)
    bad = 0
    for name, plan in PLANS.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            columns, left, names, right = compare(spark, con, plan, SQL.get(name), folder)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(error).__name__}: {error}", flush=True)
            continue
        took = time.time() - start
        if right is None:
            print(f"rows {name}: {len(left)} rows {took:.1f}s {columns} {left[:1]}", flush=True)
        elif sorted(columns) != sorted(names):
            bad += 1
            print(f"COLUMNS {name}: {sorted(columns)} != {sorted(names)}", flush=True)
        elif left != right:
            bad += 1
            off = [(a, b) for a, b in zip(left, right) if a != b]
            print(f"DIFF {name}: {len(left)} vs {len(right)} rows, {sorted(columns)} {off}", flush=True)
        else:
            print(f"ok   {name}: {len(left)} rows {took:.1f}s", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
