"""Run registered queries in Spark and their SQL in DuckDB and compare rows.

Usage: python tests/oracle_check.py [--sf DIR] [--cpus N] [--partitions N] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def cell(x: object) -> object:
    """One form for values that only differ in type between the engines."""
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, float) and math.isfinite(x) and x == int(x):
        return int(x)
    return x


def rows_of(cols: list[str], rows: list) -> list:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t)))


def compare(df, con, sql: str) -> str:
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return f"ok {len(got)}"


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--cpus", default="8")
    p.add_argument("--partitions", default="8")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from textlabel.session import build_session

    spark = build_session(
        master=f"local[{a.cpus}]", spark__sql__shuffle__partitions=a.partitions, spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, all_queries = connect(a.sf), oracle_sql(), queries()
    failed = 0
    for name in a.names or all_queries:
        start = time.time()
        try:
            df = all_queries[name](spark, a.sf)
            if name in sqls:
                result = compare(df, con, sqls[name])
            else:
                result = f"ok rows-only {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            result = f"error {type(e).__name__}: {str(e).replace(chr(10), " ")[:300]}"
            if len(a.names) == 1:
                traceback.print_exc()
        spark.catalog.clearCache()
        failed += not result.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.1f}s  {result}", flush=True)
    print("unregistered sql:", sorted(set(sqls) - set(all_queries)), "failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
