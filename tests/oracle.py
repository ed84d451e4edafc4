"""Runs a query and its SQL and compares the rows. Also a script: python tests/oracle.py SF NAME..."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in data)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[:-8]
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    return con


def compare(spark, folder: str, fn, sql: str) -> tuple[int, str]:
    df = fn(spark, folder)
    cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(folder).execute(sql)
    cols2, want = rows([c[0] for c in rel.description], rel.fetchall())
    if cols != cols2:
        return sum(got.values()), f"columns {cols} {cols2}"
    if got != want:
        return sum(got.values()), f"{sum(want.values())} wanted; too many {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}"
    return sum(got.values()), ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from siltstone import get_spark

    spark = get_spark(8)
    folder = f"/root/testdata/{sys.argv[1]}"
    bad = 0
    for name in sys.argv[2:] or e.queries():
        t = time.time()
        if name in e.oracle_sql():
            try:
                n, why = compare(spark, folder, e.queries()[name], e.oracle_sql()[name])
            except Exception as x:  # noqa: BLE001
                n, why = -1, str(x)[:700]
        else:
            try:
                n, why = e.queries()[name](spark, folder).count(), ""
            except Exception as x:  # noqa: BLE001
                n, why = -1, str(x)[:1500]
        bad += bool(why)
        print(f"{name}: {n} rows, {time.time() - t:.1f} s {'NO: ' + why if why else 'ok' if name in e.oracle_sql() else 'ran'}", flush=True)
    sys.exit(bool(bad))
