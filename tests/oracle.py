"""Runs registered queries next to their SQL in DuckDB and compares rows, columns and values.

Command line: python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
DEFAULT_SF = "/root/testdata/sf0.01"


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", "nan" if v != v else repr(v + 0.0))
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, int):
        return ("i", str(v))
    if isinstance(v, dt.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    if v is None:
        return ("", "null")
    return (type(v).__name__, str(v))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_norm(r[i]) for i in order) for r in rows])


def compare(spark_df, con, sql):
    """Empty string when equal, else what differs."""
    got_cols, got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = table(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        return f"rows {len(got)} != {len(want)}; e.g. {extra}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b][:4]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {cells}", len(got)
    return "", len(got)


def main(argv):
    from tickerweave.session import local_session

    import __spark_entry__ as entry

    sf = DEFAULT_SF
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                msg, n = compare(fn(spark, sf), con, oracles[name])
                kind = "oracle"
            else:
                n, msg, kind = len(fn(spark, sf).collect()), "", "rows"
        except Exception as exc:  # noqa: BLE001
            msg, n, kind = f"{type(exc).__name__}: {str(exc)[:600]}", -1, "error"
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name:32s} {kind} rows={n} {time.time() - t0:.1f}s {msg}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
