"""Runs queries against their SQL, as the driver does: python tests/compare.py [--sf DIR] [NAME...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canon(rows, columns) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([f"{r[i]:.6g}" if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


def compare(spark, name, query, sql, sf_dir, con) -> str:
    """'' if rows and columns agree, else what differs."""
    df = query(spark, sf_dir)
    ours = canon([tuple(r) for r in df.collect()], df.columns)
    if not ours:
        print(f"  {name} has no rows")
    if sql is None:
        return f"rows only: {len(ours)}"
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    theirs = canon(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL {sorted(names)}"
    if ours != theirs:
        a, b = set(ours), set(theirs)
        return f"{len(ours)} rows, SQL {len(theirs)}; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    from codequarry.session import local_session

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    wanted = [a for a in args if not a.startswith("--") and a != sf]
    spark = local_session(8, 8)
    con = connect(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    for n in wanted or qs:
        t = time.time()
        try:
            said = compare(spark, n, qs[n], sqls.get(n), sf, con)
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{n}: {'ok' if not said else said} ({time.time() - t:.1f} s)", flush=True)
