"""Run queries on Spark and their SQL on DuckDB and compare; usable as a script.

    python -m tests.parity [folder] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r),
    )


def compare(spark, con, query, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = query.build(spark, folder)
    got = rows_of(df.columns, df.collect())
    seconds = time.time() - start
    if query.sql is None:
        return True, f"rows only: {len(got)} rows, {seconds:.1f}s"
    result = con.execute(query.sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        first = next((p for p in zip(got, want) if p[0] != p[1]), None)
        return False, f"{len(got)} rows against {len(want)}; first difference {str(first)[:500]}"
    return True, f"{len(got)} rows, {seconds:.1f}s"


def main() -> int:
    from dockledger.plans import REGISTRY
    from dockledger.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(REGISTRY)
    spark, con, bad = local_session(8), duck(folder), 0
    for name in wanted:
        try:
            ok, note = compare(spark, con, REGISTRY[name], folder)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
