"""Run registered queries and their SQL side by side.

    python -m tests.oracle [sf_dir] [name ...]
"""

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    return got, want


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from ledgerloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(oracle_sql())
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    duck, bad = connect(sf), []
    for key in chosen:
        begin = time.time()
        try:
            a, b = compare(session, duck, sf, queries()[key], oracle_sql()[key])
            ok = a == b
            note = "" if ok else f"{a[0]} {b[0]} {len(a[1])} {len(b[1])} " + str(
                [(x, y) for x, y in zip(a[1], b[1]) if x != y][:2])
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__} {str(error)[:1500]}"
        if not ok:
            bad.append(key)
        print("ok " if ok else "BAD", key, len(a[1]) if ok else "", f"{time.time() - begin:.2f}s", note, flush=True)
    print("failed:", bad)
