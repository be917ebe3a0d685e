"""Run the named queries and compare them with their SQL in DuckDB.

usage: python tools/check_queries.py <folder> [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmark.plans.registry import load_all  # noqa: E402
from shelfmark.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main(folder: str, names: list[str]) -> int:
    spark = build_session("check", f"local[{os.environ.get('CPUS', '8')}]", 8,
                          **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name, q in load_all().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = q.run(spark, folder)
            got = table(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # keep going: the point is the list of failures
            bad += 1
            print(f"FAIL  {name}: {str(error)[:900]}", flush=True)
            continue
        took = time.time() - start
        if not q.sql:
            print(f"rows  {name}: {len(got[1])} rows {took:.2f}s", flush=True)
            continue
        try:
            cur = con.execute(q.sql)
            columns = [d[0] for d in cur.description]
            want = table(columns, cur.fetchall())
        except Exception as error:
            bad += 1
            print(f"SQL   {name}: {str(error)[:600]}", flush=True)
            continue
        if got == want:
            print(f"ok    {name}: {len(got[1])} rows {took:.2f}s", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name}: columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}")
        here, there = set(got[1]), set(want[1])
        for row in sorted(here - there)[:3]:
            print("   spark", str(row)[:400])
        for row in sorted(there - here)[:3]:
            print("   sql  ", str(row)[:400], flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
