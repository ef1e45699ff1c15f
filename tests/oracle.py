"""Runs registered queries on Spark and on DuckDB and compares whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v
        return v
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql, sf_dir):
    """(message or None, row count, Spark seconds)."""
    start = time.time()
    df = run(spark, sf_dir)
    got_columns, got = rows_of(df.columns, df.collect())
    seconds = time.time() - start
    res = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in res.description], res.fetchall())
    n = sum(got.values())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", n, seconds
    if got != want:
        return (f"{n} rows vs {sum(want.values())}; only spark {list((got - want).items())[:2]}; "
                f"only duckdb {list((want - got).items())[:2]}"), n, seconds
    types = {c: (str(t), dict(df.dtypes)[c]) for c, t in ((d[0], d[1]) for d in res.description)}
    expected = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
                "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}
    odd = {c: t for c, t in types.items() if expected.get(t[0], t[1] if t[0].startswith("DECIMAL") else None) != t[1]}
    if odd:
        return f"types {odd}", n, seconds
    if n == 0:
        return "no rows", n, seconds
    return None, n, seconds


def main(argv):
    import __spark_entry__ as entry
    from farelake.session import build_session

    sf_dir = f"/root/testdata/{argv[1]}"
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if len(argv) > 2 and name not in argv[2:]:
            continue
        try:
            if name in oracles:
                message, n, seconds = compare(spark, con, run, oracles[name], sf_dir)
            else:
                start = time.time()
                n = len(run(spark, sf_dir).collect())
                message, seconds = None, time.time() - start
                name += " (rows only)"
        except Exception as e:  # report and go on
            message, n, seconds = f"{type(e).__name__}: {str(e)[:1500]}", -1, 0
        bad += message is not None
        print(f"{'FAIL' if message else 'ok':5}{name:34}{n:9}{seconds:8.2f}s {message or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv)
