"""Runs registered queries in Spark and their SQL twins in DuckDB and compares them.

As a script: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
         "VARCHAR[]": "array<string>"}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def _plain(value):
    return tuple(value) if isinstance(value, list) else value


def difference(spark_df, con, sql: str) -> str | None:
    """None if schema and values are equal, otherwise the first difference."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = dict(zip(names, [TYPES.get(str(c[1]), str(c[1])) for c in cur.description]))
    theirs = cur.fetchall()
    ours_kinds = dict(spark_df.dtypes)
    if ours_kinds != kinds:
        return f"schema: spark {ours_kinds} sql {kinds}"
    order = sorted(names)
    ours = _sorted([tuple(_plain(r[c]) for c in order) for r in spark_df.collect()])
    theirs = _sorted([tuple(_plain(r[names.index(c)]) for c in order) for r in theirs])
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:3] if len(ours) < 100_000 else []
        return f"rows: spark {len(ours)} sql {len(theirs)}; only in spark {extra}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"values {order}: spark {a} sql {b}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from martlet.plans.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session("8"), duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    unknown = set(sql) - set(queries)
    if unknown:
        print("SQL without a query:", sorted(unknown))
    bad = 0
    for name, build in queries.items():
        if args and name not in args:
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            if name in sql:
                verdict = difference(df, con, sql[name]) or "equal"
            else:
                verdict = f"no SQL, {len(df.collect())} rows, {df.dtypes}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not verdict.startswith(("equal", "no SQL"))
        print(f"{name:36s} {time.time() - started:6.2f}s {verdict}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
