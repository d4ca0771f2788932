"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if hasattr(v, "item"):
        v = v.item()
        return _cell(v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(([_cell(row[i]) for i in order] for row in data), key=repr)


def compare(spark, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    t1 = time.time()
    con = connect(sf_dir)
    res = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    t2 = time.time()
    problems = []
    if got_cols != want_cols:
        problems.append(f"columns {got_cols} vs {want_cols}")
    elif len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    else:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        if bad:
            problems.append(f"{len(bad)} differing rows, e.g.\n   {bad[0][0]}\n   {bad[0][1]}")
    return problems, len(got), t1 - t0, t2 - t1


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from candlewick.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session(8)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            if name not in sqls:
                t0 = time.time()
                print("ROWS", name, query(spark, sf).count(), f"{time.time() - t0:.1f}s", flush=True)
                continue
            problems, n, a, b = compare(spark, name, query, sqls[name], sf)
            print("OK  " if not problems else "DIFF", name, n, f"spark {a:.1f}s duckdb {b:.1f}s", *problems, flush=True)
        except Exception as e:  # noqa: BLE001
            print("FAIL", name, str(e)[:1500], flush=True)
