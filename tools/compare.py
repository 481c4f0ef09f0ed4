"""Run registered queries next to their SQL on DuckDB and report differences.

    python tools/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, duck, name, query, sql, folder):
    start = time.time()
    df = query(spark, folder)
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    spark_seconds = time.time() - start
    if sql is None:
        return None, f"{len(got)} rows, no SQL to compare with, {spark_seconds:.1f}s"
    start = time.time()
    cursor = duck.execute(sql)
    want_columns, want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    duck_seconds = time.time() - start
    note = f"{len(got)} rows, spark {spark_seconds:.1f}s, duckdb {duck_seconds:.1f}s"
    if got_columns != want_columns:
        return False, f"{note}\n   columns {got_columns} != {want_columns}"
    if got != want:
        a, b = set(got), set(want)
        only = [f"   spark  {x}" for x in sorted(a - b)[:4]] + [f"   duckdb {x}" for x in sorted(b - a)[:4]]
        return False, "\n".join([f"{note} vs {len(want)}; {len(a - b)} / {len(b - a)} differ", *only])
    return True, note


def open_duck(folder):
    import duckdb

    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return duck


def main():
    from larder.plans import ORACLES, QUERIES
    from larder.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, duck = local_session(), open_duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), folder)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("none" if ok is None else "ok  " if ok else "FAIL", name, note, flush=True)
        if ok is False:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok", *bad)


if __name__ == "__main__":
    main()
