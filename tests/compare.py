"""Run registered queries next to their SQL: ``python -m tests.compare [folder] [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def differences(frame, connection, sql) -> tuple[int, list[str]]:
    """Row count and what differs: column names, value kinds, rows."""
    names = sorted(frame.columns)
    rows = Counter(tuple(_plain(r[n]) for n in names) for r in frame.select(*[f"`{n}`" for n in names]).collect())
    n = sum(rows.values())
    if sql is None:
        return n, []
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return n, [f"columns {names} and {sorted(columns)}"]
    place = [columns.index(c) for c in names]
    expected = Counter(tuple(_plain(r[i]) for i in place) for r in result.fetchall())
    found = []
    if rows != expected:
        found.append(f"rows {n} and {sum(expected.values())}")
        found += [f"only Spark: {r}"[:300] for r in list((rows - expected))[:2]]
        found += [f"only SQL:   {r}"[:300] for r in list((expected - rows))[:2]]
    kinds = [{type(v) for r in side for v in r if v is not None} for side in (rows, expected)]
    if rows and kinds[0] != kinds[1]:
        found.append(f"types {kinds}")
    return n, found


def main() -> None:
    from ledgerlake.plans.catalog import ORACLES, QUERIES
    from ledgerlake.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, found = differences(QUERIES[name](spark, folder), connection, ORACLES.get(name))
        except Exception as problem:  # noqa: BLE001
            n, found = -1, [f"{type(problem).__name__}: {str(problem)[:1500]}"]
        bad += bool(found)
        kind = "sql" if name in ORACLES else "rows only"
        print(f"{'BAD' if found else 'ok ':3} {name:26} {n:8} rows {time.time() - start:6.1f}s  {kind}", flush=True)
        for line in found:
            print("     ", line, flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
