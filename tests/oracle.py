"""Runs catalogue queries next to their SQL on DuckDB and compares the results.

    python -m tests.oracle [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback
from decimal import Decimal

import duckdb

from loomgraph.sources.binding import TABLES

ROOT = os.environ.get("LOOMGRAPH_TESTDATA", "/root/testdata")


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/sf{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def exact(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str | None:
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    a, b = normal(spark_rows, spark_cols), normal(duck_rows, duck_cols)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {x!r} vs {y!r}"[:600]
    return None


def run(spark, sf: str, names, con=None, loud=True):
    import __spark_entry__ as entry

    con = con or duck(sf)
    queries, sql, bad = entry.queries(), entry.oracle_sql(), {}
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, f"{ROOT}/sf{sf}")
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            if name not in sql:
                note = f"rows only ({len(rows)})"
            else:
                t1 = time.time()
                cur = con.execute(sql[name])
                cols = [d[0] for d in cur.description]
                got = cur.fetchall()
                problem = compare(rows, df.columns, got, cols)
                note = f"ok ({len(rows)})" if problem is None else problem
                note += f" sql {time.time() - t1:.1f}s"
                if problem is None and not rows:
                    note = "EMPTY " + note
                if problem is not None:
                    bad[name] = problem
        except Exception as exc:  # noqa: BLE001
            took = time.time() - t0
            note = bad[name] = f"{type(exc).__name__}: {str(exc)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if loud:
            print(f"{took:6.2f}s {name}: {note}", flush=True)
    return bad


if __name__ == "__main__":
    from loomgraph.session import local_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    every = list(entry.queries())
    names = [n for n in every if not args or any(n.startswith(a) for a in args)]
    spark = local_session(cpus=8)
    failed = run(spark, sf, names)
    print(f"{len(names) - len(failed)} of {len(names)} good; failed: {sorted(failed)}")
    spark.stop()
