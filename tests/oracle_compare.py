"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

Usage: python tests/oracle_compare.py [sf] [name-prefix,...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is not None, type(x).__name__ if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in row)


def compare(spark, con, name, query, statement, folder, tol=0.0):
    t0 = time.time()
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = [tuple(norm(x) for x in row) for row in df.select(*[f"`{c}`" for c in cols]).collect()]
    t1 = time.time()
    if statement is None:
        return len(got) > 0, f"{len(got)} rows, no SQL", t1 - t0, 0.0
    rel = con.execute(statement)
    names = [c[0] for c in rel.description]
    rows = rel.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}", t1 - t0, t2 - t1
    pos = [names.index(c) for c in cols]
    want = [tuple(norm(row[p]) for p in pos) for row in rows]
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}", t1 - t0, t2 - t1
    got.sort(key=key)
    want.sort(key=key)
    bad, exact = [], True
    for a, b in zip(got, want):
        if a != b:
            exact = False
            for x, y, c in zip(a, b, cols):
                close = isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(y))
                if x != y and not (close and tol):
                    bad.append((c, x, y, a[:6]))
                    break
    types = {type(x).__name__ for row in got for x in row} ^ {type(x).__name__ for row in want for x in row}
    nulls = [c for j, c in enumerate(cols) if got and all(row[j] is None for row in got)]
    note = f"{len(got)} rows" + (f" TYPES {types}" if types else "") + (f" ALLNULL {nulls}" if nulls else "")
    if not got:
        note += " EMPTY"
    if bad or not exact:
        return False, f"{note}; {len(bad)} differ, e.g. {bad[:3]}", t1 - t0, t2 - t1
    return True, note, t1 - t0, t2 - t1


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    from tapeloom.session import local_session
    from tapeloom.suite import load

    folder = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    for name, q in queries.items():
        if wanted and not any(name.startswith(x) for x in wanted):
            continue
        try:
            ok, note, ts, td = compare(spark, con, name, q, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, note, ts, td = False, f"{type(e).__name__}: {str(e)[:1200]}", 0, 0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} spark {ts:6.2f}s duck {td:5.2f}s {note}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
