"""Run registered queries beside their SQL and compare values without order."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int | Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, query, sql):
    frame = query(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(set(frame.columns) ^ set(names))}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
            return f"first difference {bad[:3]}"
    return None


def main(argv):
    root = str(Path(__file__).resolve().parents[1])
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from flowguard.session import build_session

    folder = argv[0]
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = argv[1:] or list(queries)
    failed = 0
    for name in [n for n in queries if any(n == c or (c.endswith("*") and n.startswith(c[:-1])) for c in chosen)]:
        begin = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, folder, queries[name], oracles[name])
            else:
                problem = None if queries[name](spark, folder).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"CHECK {name:28s} {kind:6s} {time.time() - begin:6.2f}s {problem or 'ok'}", flush=True)
    print(f"CHECK failed={failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
