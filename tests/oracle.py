"""Compare a Spark result with its SQL twin in DuckDB (order-insensitive, by value)."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql, sf_dir: str) -> dict:
    started = time.time()
    df = query(spark, sf_dir)
    mine = df.collect()
    seconds = time.time() - started
    result = {"rows": len(mine), "seconds": round(seconds, 2), "ok": True, "note": "rows only" if sql is None else ""}
    if sql is None:
        return result
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return {**result, "ok": False, "note": f"columns {sorted(df.columns)} / {sorted(names)}"}
    a, b = rows(df.columns, mine), rows(names, theirs)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3] if len(a) < 200000 else []
        only_b = [r for r in b if r not in set(a)][:3] if len(b) < 200000 else []
        return {**result, "ok": False, "note": f"{sorted(names)}: {len(a)} vs {len(b)} rows; spark {only_a} sql {only_b}"}
    return result
