"""Run named queries beside their SQL and compare the rows: ``python tools/check.py [sf or folder] [prefix ...]``."""

from __future__ import annotations

import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from guardedlake.plans.all_queries import NAMED
from guardedlake.session import get_spark
from guardedlake.sources.tables import STAR_TABLES


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def row_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(canonical(r[i]) for i in order) for r in rows)


def digest(rows):
    return hashlib.sha256("\x1e".join(rows).encode()).hexdigest()


def oracle(folder):
    con = duckdb.connect()
    for t in STAR_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, name, folder):
    """(status, number of rows, seconds, note)"""
    query = NAMED[name]
    start = time.time()
    df = query.run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if query.sql is None:
        return "rows", len(rows), seconds, ""
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(rows), seconds, f"{sorted(df.columns)} / {sorted(names)}"
    got, exp = row_set(df.columns, rows), row_set(names, want)
    if digest(got) == digest(exp):
        return "ok", len(rows), seconds, ""
    a, b = [r for r in got if r not in set(exp)], [r for r in exp if r not in set(got)]
    return "DIFF", len(rows), seconds, f"rows {len(got)}/{len(exp)}\n   spark {a[:2]}\n   sql   {b[:2]}"[:1500]


def main(argv):
    sf, prefixes = (argv[0] if argv else "0.01"), argv[1:]
    folder = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle(folder), 0
    for name in NAMED:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, n, seconds, note = compare(spark, con, name, folder)
        except Exception as failure:
            status, n, seconds, note = "FAIL", 0, 0.0, f"{type(failure).__name__}: {failure}"[:1200]
        bad += status not in ("ok", "rows")
        print(f"{status:8}{name:40}{n:9}{seconds:8.2f}s {note}", flush=True)
    print("not matching:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
