"""Runs registered queries next to their SQL in DuckDB. `python tests/oracle.py [sf_dir] [name ...]`"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as driver  # noqa: E402
from assayer.plans.bindings.base import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    )


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = driver.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in driver.oracle_sql():
        return True, f"{len(got)} rows, no SQL"
    cursor = con.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    kinds = dict(zip(columns, [str(c[1]) for c in cursor.description]))
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    odd = {c: k for c, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k}
    if got != want:
        here, there = set(got), set(want)
        extra, lost = [r for r in got if r not in there][:3], [r for r in want if r not in here][:3]
        return False, f"{len(got)} against {len(want)} rows\n   {sorted(columns)}\n   only here  {extra}\n   only there {lost}"
    return True, f"{len(got)} rows" + (f" (types {odd})" if odd else "")


if __name__ == "__main__":
    from assayer.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or sorted(driver.queries())
    session, con = local_session(8), connect(sf_dir)
    bad = []
    for query_name in chosen:
        start = time.time()
        try:
            ok, message = compare(session, con, query_name, sf_dir)
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {query_name:14} {time.time() - start:6.2f}s {message}", flush=True)
        if not ok:
            bad.append(query_name)
    print(f"{len(chosen) - len(bad)} of {len(chosen)} agree; failing: {bad}")
