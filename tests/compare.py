"""Run named queries next to their SQL twins and compare the rows.

Usage: python -m tests.compare [sf or folder] [name ...]

SPARK_CONF may hold more settings, as "key=value,key=value".
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value)
    return repr(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    theirs = connection.execute(sql)
    their_columns = [c[0] for c in theirs.description]
    their_types = {c[0]: str(c[1]) for c in theirs.description}
    their_rows = rows_of(their_columns, theirs.fetchall())
    if sorted(spark_df.columns) != sorted(their_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(their_columns)}"
    our_rows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    kinds = {
        "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
        "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    }
    wrong = {
        n: (t, their_types[n]) for n, t in spark_df.dtypes
        if t in kinds and kinds[t] not in their_types[n].upper()
    }
    if wrong:
        return f"types {wrong}"
    if len(our_rows) != len(their_rows):
        return f"rows {len(our_rows)} != {len(their_rows)}"
    for ours, expected in zip(our_rows, their_rows):
        if ours != expected:
            names = sorted(their_columns)
            return str([(n, a, b) for n, a, b in zip(names, ours, expected) if a != b])
    return None


def main() -> None:
    import __spark_entry__ as entry
    from lexgauge.session import build_session

    args = sys.argv[1:]
    place = args.pop(0) if args and args[0][0] in "0123456789/" else "0.01"
    extra = dict(pair.split("=", 1) for pair in os.environ.get("SPARK_CONF", "").split(",") if pair)
    spark = build_session("compare", "local[8]", 8, spark__ui__enabled="false", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = place if place.startswith("/") else f"/root/testdata/sf{place}"
    connection = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = difference(df, connection, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem[:600]}"
                count = connection.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
            else:
                count, problem, state = df.count(), None, "rows only"
        except Exception as error:  # report and go on with the next query
            count, problem, state = -1, "error", f"ERROR {str(error)[:900]}"
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name:28s} {count:8d} {state}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
