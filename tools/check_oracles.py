"""Run registered queries beside their SQL on DuckDB and compare rows, names, kinds and values.

Usage: python tools/check_oracles.py [--sf DIR] [name-substring ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from trailmark.plans import ORACLES, QUERIES, load_all
from trailmark.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    a = [tuple(r[spark_cols.index(c)] for c in order) for r in spark_rows]
    b = [tuple(r[duck_cols.index(c)] for c in order) for r in duck_rows]
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for i, c in enumerate(order):
        ka = {kind(r[i]) for r in a} - {None}
        kb = {kind(r[i]) for r in b} - {None}
        if ka != kb:
            return f"kind of {c}: {ka} vs {kb}"
    sa = sorted(tuple(map(cell, r)) for r in a)
    sb = sorted(tuple(map(cell, r)) for r in b)
    bad = [(x, y) for x, y in zip(sa, sb) if x != y]
    if bad:
        x, y = bad[0]
        return f"{len(bad)} of {len(sa)} rows differ, first {dict(zip(order, x))} vs {dict(zip(order, y))}"[:1500]
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    load_all()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    duck.execute("set timezone='UTC'") if False else None
    for name in TABLES:
        duck.execute(f"create view {name} as select * from '{args.sf}/{name}.parquet'")
    failed = 0
    for name, fn in QUERIES.items():
        if args.names and not any(n in name for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows-only {name}: {len(rows)} rows {took:.1f}s {rows[:1]!r}"[:300], flush=True)
                continue
            result = duck.execute(ORACLES[name])
            columns = [d[0] for d in result.description]
            problem = compare(rows, df.columns, result.fetchall(), columns)
        except Exception as error:  # report and go on with the next query
            problem, took, rows = f"{type(error).__name__}: {str(error)[:900]}", time.time() - start, []
        if problem:
            failed += 1
            print(f"FAIL {name} ({took:.1f}s): {problem}", flush=True)
        else:
            note = " EMPTY" if not rows else ""
            print(f"ok {name}: {len(rows)} rows {took:.1f}s{note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
