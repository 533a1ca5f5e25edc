"""Run registered queries and their SQL on one data folder and compare the rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def oracle_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return rows_of(columns, cur.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from prefixloom.session import local

    spark = local()
    con = views(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            got_cols, got = spark_rows(queries[name](spark, folder))
            took = time.time() - start
            if name not in oracles:
                print(f"{name:24s} {took:6.2f}s rows {len(got):7d}  (rows only)", flush=True)
                continue
            start = time.time()
            cols, want = oracle_rows(con, oracles[name])
            sql_took = time.time() - start
            same = got_cols == cols and got == want
            bad += not same
            print(f"{name:24s} {took:6.2f}s rows {len(got):7d}  sql {sql_took:6.2f}s rows {len(want):7d}  {'ok' if same else 'DIFFERENT'}", flush=True)
            if not same:
                print("   columns", got_cols, cols)
                have, need = set(map(repr, got)), set(map(repr, want))
                print("   only spark", sorted(have - need)[:3])
                print("   only sql  ", sorted(need - have)[:3], flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"{name:24s} FAILED {type(error).__name__}: {str(error)[:700]}", flush=True)
    print("not equal or failed:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    sys.exit(1 if main(where, args) else 0)
