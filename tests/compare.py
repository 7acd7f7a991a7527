"""Run registered queries against their SQL in DuckDB.

``python tests/compare.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("ledgerlens-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def check(spark, con, sf_dir: str, name: str, run, sql) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = normal(names, cur.fetchall())
    sql_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    mine = normal(df.columns, rows)
    if mine == theirs:
        return True, f"{len(mine)} rows, spark {took:.1f}s, duckdb {sql_took:.1f}s"
    a, b = set(mine), set(theirs)
    return False, f"{len(mine)} vs {len(theirs)} rows; only spark {list(a - b)[:3]}; only duckdb {list(b - a)[:3]}"


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    oracle = entry.oracle_sql()
    bad = []
    for name, run in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(a) for a in argv[1:]):
            continue
        try:
            ok, note = check(spark, con, sf_dir, name, run, oracle.get(name))
        except Exception:
            ok, note = False, traceback.format_exc(limit=-3)[:1800]
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
