"""Runs named queries in Spark and their oracles in DuckDB and compares all cells.

python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted_rows(df.columns, df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return sorted_rows([d[0] for d in cursor.description], cursor.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}; first {left[1][:1]} / {right[1][:1]}"
    wrong = [(x, y) for x, y in zip(left[1], right[1]) if x != y or repr(x) != repr(y) or list(map(type, x)) != list(map(type, y))]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    from tests.conftest import make_session

    spark = make_session()
    con = connect(folder)
    oracle, bad = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            got = spark_rows(query(spark, folder))
            took = time.time() - start
            diff = difference(got, duck_rows(con, oracle[name])) if name in oracle else None
            note = diff or ("ok" if name in oracle else "rows only")
            n = len(got[1])
        except Exception as error:  # report and go on with the next query
            took, diff, n = time.time() - start, True, -1
            note = f"{type(error).__name__}: {str(error)[:1500]}"
        if diff:
            bad.append(name)
        print(f"{name:28} {n:7} rows {took:6.2f}s  {note}", flush=True)
    print("FAILED:", bad if bad else "none")


if __name__ == "__main__":
    main()
