"""Compare registered queries with their DuckDB oracle.

    python -m tests.oracle [--sf 0.01] [prefix ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
import traceback

import duckdb

TESTDATA = "/root/testdata"


def session(name="glacierlens-tests", cpus=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _norm(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(_norm(y) for y in x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(_norm(row[i]) for i in order) for row in rows]
    body.sort(key=lambda t: tuple((v is None, type(v).__name__ if not isinstance(v, (int, float, bool)) else "n", _key(v)) for v in t))
    return [columns[i] for i in order], body


def _key(v):
    return 0 if v is None else (round(v, 4) if isinstance(v, float) else v)


def compare(name, spark_df, con, sql):
    """None when equal, else a message.  Floats must be equal exactly."""
    rel = con.sql(sql)
    dcols, drows = table(list(rel.columns), rel.fetchall())
    scols, srows = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if dcols != scols:
        return f"columns {scols} vs {dcols}", len(srows)
    if len(drows) != len(srows):
        return f"rows {len(srows)} vs {len(drows)}; e.g. {srows[:2]} vs {drows[:2]}", len(srows)
    bad = close = 0
    sample = None
    for a, b in zip(srows, drows):
        if a == b and all(type(x) is type(y) for x, y in zip(a, b)):
            continue
        near = all(
            x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y)))
            for x, y in zip(a, b)
        )
        typed = all(x is None or y is None or type(x) is type(y) for x, y in zip(a, b))
        if near and typed:
            close += 1
        else:
            bad += 1
        sample = sample or (a, b)
    if bad or close:
        return f"{bad} rows differ, {close} only by rounding, of {len(srows)}: {sample}", len(srows)
    if not srows:
        return "EMPTY", 0
    return None, len(srows)


def main(argv):
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark, con = session(), connect(sf_dir)
    qs, oracles = entry.queries(), entry.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                msg, n = compare(name, df, con, oracles[name])
            else:
                n = len(df.collect())
                msg = None if n else "EMPTY"
            kind = "ok" if name in oracles else "rows"
        except Exception as e:  # report and go on with the next query
            msg, n, kind = f"{type(e).__name__}: {str(e)[:1500]}", 0, "err"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        fails += msg is not None
        print(f"{'FAIL' if msg else kind:5s} {name:40s} {n:7d} rows {time.time() - t:6.2f}s {msg or ''}", flush=True)
    print("failures:", fails)
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
