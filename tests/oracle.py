"""Runs queries beside their SQL: ``python tests/oracle.py FOLDER NAME...`` (all names if none)."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows(columns: list[str], data: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def compared(spark: SparkSession, folder: str, query, sql: str) -> tuple[list[str], list[str], Counter, Counter]:
    df = query(spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    c = views(folder)
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(df.columns), sorted(names), ours, rows(names, cursor.fetchall())


if __name__ == "__main__":
    import __spark_entry__ as entry

    from tallyforge.session import local_session

    spark, folder, names = local_session(), sys.argv[1], sys.argv[2:]
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"{name}: rows only, {query(spark, folder).count()} rows, {time.time() - start:.1f} s", flush=True)
                continue
            a, b, x, y = compared(spark, folder, query, sql)
            good = a == b and x == y
            print(f"{name}: {'match' if good else 'DIFFER'} {sum(x.values())} rows, {sum(y.values())} by SQL, {time.time() - start:.1f} s", flush=True)
            if not good:
                print("  columns", a, b, "\n  ours", list((x - y).items())[:4], "\n  sql", list((y - x).items())[:4])
        except Exception as e:  # noqa: BLE001
            print(f"{name}: FAILED {str(e)[:1500]}", flush=True)
