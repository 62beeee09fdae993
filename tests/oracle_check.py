"""Run registered queries beside their DuckDB SQL and compare whole results.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float"
    if isinstance(v, datetime.datetime):
        return "ts"
    return type(v).__name__


def compare(con, spark, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "rows", len(rows), t1 - t0, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != cols:
        return "COLUMNS", len(rows), t1 - t0, f"{cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in want]
    for i, c in enumerate(cols):
        a = {kind(r[i]) for r in rows if r[i] is not None}
        b = {kind(r[i]) for r in want if r[i] is not None}
        if a and b and a != b:
            return "TYPES", len(rows), t1 - t0, f"{c}: {a} vs {b}"
    got, exp = sorted(tuple(map(cell, r)) for r in rows), sorted(tuple(map(cell, r)) for r in want)
    if got == exp:
        return ("ok" if rows else "EMPTY"), len(rows), t1 - t0, ""
    a, b = set(got) - set(exp), set(exp) - set(got)
    return "DIFF", len(rows), t1 - t0, (f"{len(got)} vs {len(exp)} cols={cols}\n   spark {sorted(a)[:3]}"
                                        f"\n   duck  {sorted(b)[:3]}")


def main(argv):
    import duckdb
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    spark = build_session("oracle-check", "local[8]", **{
        "spark__sql__shuffle__partitions": 8, "spark__ui__enabled": "false",
        "spark__driver__memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1]))
                                                  for a in argv)]
    bad = 0
    for n in names:
        try:
            status, rows, sec, note = compare(con, spark, n, queries[n], oracle.get(n), sf)
        except Exception as e:  # report and go on with the next query
            status, rows, sec, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        bad += status not in ("ok", "rows")
        print(f"{status:8}{n:38}{rows:8}{sec:7.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} not ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
