"""Run registered queries against their SQL twins: python tests/check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from caseflow.session import local_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        try:
            r = oracle.compare(spark, con, queries[name], sql.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            r = {"ok": False, "rows": -1, "seconds": 0, "note": f"{type(exc).__name__}: {str(exc)[:600]}"}
        bad += not r["ok"]
        print(f"{'ok ' if r['ok'] else 'BAD'} {name:28s} rows={r['rows']:<7} {r['seconds']:>6}s {r['note']}", flush=True)
    print(f"{bad} bad of {len(wanted or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
