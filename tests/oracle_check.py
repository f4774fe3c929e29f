"""Run registered queries beside their SQL and report what differs.

usage: python tests/oracle_check.py [sf dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    got_cols = df.columns
    got = canonical(got_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = canonical(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            names = sorted(got_cols)
            return "first difference " + str([(n, x, y) for n, x, y in zip(names, a, b) if x != y][:4])
    return None


def main(argv: list[str]) -> int:
    from nodetide.session import build_session

    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            note = compare(df, con, oracle[name]) if name in oracle else f"rows only: {df.count()}"
            failed = name in oracle and note is not None
        except Exception as error:  # report and go on with the next query
            note, failed = f"{type(error).__name__}: {str(error)[:600]}", True
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name:28s} {time.time() - start:6.2f}s {note or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
