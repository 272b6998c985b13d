"""Run registered queries against DuckDB on the given tables: ``python tests/compare.py [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, db, sql: str) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    fetched = result.fetchall()
    if time.time() - start > 5:
        print(f"     (oracle took {time.time() - start:.1f}s)")
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(columns, fetched)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{str(a)[:600]} != {str(b)[:600]}"
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from corpusloom.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, db = build_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            told = compare(df, db, oracle[name]) if name in oracle else f"rows only: {df.count()}"
        except Exception as error:
            told = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad = told is not None and not told.startswith("rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:28s} {time.time() - start:6.2f}s {told or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
