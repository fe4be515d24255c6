"""Run every query on Spark and DuckDB and compare the rows: python -m checks.compare [dir] [names…]"""

from __future__ import annotations

import datetime
import decimal
import sys
import time


def normal(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(normal(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row),
    )


def duck_rows(folder: str, sql: str):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def main(folder: str, names: list[str]) -> int:
    from bench import session
    from checks.catalog import all_queries
    from checks.oracles import all_statements

    spark = session(8)
    queries, oracles = all_queries(), all_statements()
    wrong = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        started = time.time()
        got = spark_rows(query(spark, folder))
        seconds = time.time() - started
        want = duck_rows(folder, oracles[name])
        verdict = "ok" if got == want else "DIFFERENT"
        print(f"{verdict:9} {name} rows={len(got[1])} {seconds:.2f}s", flush=True)
        if got != want:
            wrong += 1
            print("  columns", set(got[0]) ^ set(want[0]), "rows", len(got[1]), len(want[1]))
            bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
            for a, b in bad:
                print("  ", [(c, x, y) for c, x, y in zip(got[0], a, b) if x != y])
    return wrong


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(folder, sys.argv[2:]) > 0)
