"""Run the queries next to their SQL twins: ``python -m checks.compare [folder] [name …]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import queries
from shopledger.session import local_session


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order and exact values, sorted."""
    df = df[sorted(df.columns)]
    columns = []
    for name in df.columns:
        values = df[name]
        if str(values.dtype).startswith("datetime64"):
            values = values.dt.date
        columns.append([None if pd.isna(v) else v for v in values.tolist()])
    rows = zip(*[[repr(_plain(v)) for v in c] for c in columns])
    return sorted(rows)


def _plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (bool, int)) or value is None:
        return value
    if isinstance(value, float):
        return value + 0.0
    return value


def check(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    got = queries()[name](spark, sf_dir).toPandas()
    spent = time.time() - start
    want = con.execute(oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return True, f"{len(a)} rows, {spent:.2f} s"
    differing = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"rows {len(a)} / {len(b)}; first differences {differing}"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(queries())
    spark, con = local_session(), duck(sf_dir)
    failed = 0
    for name in names:
        try:
            ok, detail = check(spark, con, sf_dir, name)
        except Exception as e:
            ok, detail = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + detail, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
