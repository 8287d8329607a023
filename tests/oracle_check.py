"""Compare queries with their SQL on one data folder: python tests/oracle_check.py FOLDER [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter


def connect(folder: str):
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in sorted(glob.glob(f"{folder}/*.parquet")):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{files}')")
    return c


def cell(x):
    """A value in comparable form: numbers to nine digits, NaN and null alike as None."""
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else (0.0 if x == 0 else float(f"{x:.9g}"))
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if hasattr(x, "as_integer_ratio") and not isinstance(x, int):
        return cell(float(x))
    return x


def differences(spark, name: str, query, sql: str, folder: str, con=None) -> str:
    """Empty if rows and columns agree, else what differs."""
    con = con or connect(folder)
    got = query(spark, folder)
    cols = sorted(got.columns)
    rows = Counter(tuple(cell(r[c]) for c in cols) for r in got.collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    want = Counter(tuple(cell(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    if rows == want:
        return ""
    return f"{sum(rows.values())} rows against {sum(want.values())}; only here {list((rows - want).items())[:3]}; only in SQL {list((want - rows).items())[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from roadweave.session import build_session

    spark = build_session("oracle", os.environ.get("ORACLE_MASTER", "local[8]"), spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    q, sql = e.queries(), e.oracle_sql()
    con, bad = connect(sys.argv[1]), 0
    for n in sys.argv[2:] or q:
        t = time.time()
        try:
            d = differences(spark, n, q[n], sql[n], sys.argv[1], con) if n in sql else f"rows only: {q[n](spark, sys.argv[1]).count()}"
        except Exception as x:  # noqa: BLE001
            d = "ERROR " + str(x)[:1500]
        bad += bool(d) and not d.startswith("rows only")
        print(f"{n}: {d or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bad)
