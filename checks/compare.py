"""Run registered queries next to their SQL counterparts and compare values.

Usage: python -m checks.compare <folder> [names...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from basketry.session import build_session
from checks.oracle import ORACLE
from checks.queries import registered

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def difference(spark_df, rows, cursor) -> str | None:
    theirs = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(set(names) ^ set(spark_df.columns))}"
    a, b = table(spark_df.columns, rows), table(names, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} against {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            at = [(c, p, q) for c, p, q in zip(sorted(names), x, y) if p != q]
            n = sum(p != q for p, q in zip(a, b))
            return f"{n}/{len(a)} rows differ, first {at[:4]}"
    return None


def main(folder: str, names: list[str]) -> int:
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, failed = connect(folder), registered(), []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            rows = df.collect()
            took = time.time() - start
            verdict = difference(df, rows, con.execute(ORACLE[name])) if name in ORACLE else "no SQL"
        except Exception as error:  # report and go on with the other queries
            took, rows, verdict = time.time() - start, [], f"{type(error).__name__}: {str(error)[:500]}"
        if verdict not in (None, "no SQL"):
            failed.append(name)
        print(f"{name:30s} {len(rows):7d} rows {took:6.2f} s  {verdict or 'equal'}", flush=True)
    print(f"{len(failed)} differ: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
