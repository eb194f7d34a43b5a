"""Compare registered queries with their DuckDB counterparts.

``python tests/compare.py [folder] [name-part ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from catalog.views import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return ("f", f"{value + 0.0:.6f}")
    if isinstance(value, list):
        return tuple(normal(v) for v in value)
    return (type(value).__name__, value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, run, oracle):
    """Empty string when equal, else what differs."""
    df = run(spark, folder)
    got = df.collect()
    if oracle is None:
        return "" if got else "no rows"
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if not a:
        return "no rows on either side" if not b else f"0 rows, {len(b)} wanted"
    if a != b:
        left, right = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
        return f"{len(a)} rows vs {len(b)}; only spark {left[:2]}; only duckdb {right[:2]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from strandline.session import build

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, run, oracles.get(name))
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:40s} {time.time() - start:6.1f}s {'' if oracles.get(name) else '(rows only) '}{problem}", flush=True)
    print("failed", failed)
