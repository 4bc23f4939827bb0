"""Runs registered queries against DuckDB; also a script: python tests/oracle.py SF_DIR [NAME...]."""

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if v.__class__.__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if isinstance(v, dict):
        return tuple(canon(x) for x in v.values())
    return v


def compare(spark, sf_dir, name, f, sql):
    import duckdb

    from lodestar.fixtures import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = f(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    at = [names.index(c) for c in df.columns]
    key = lambda r: tuple(map(str, r))
    a, b = sorted((tuple(map(canon, r)) for r in got), key=key), sorted((tuple(canon(r[k]) for k in at) for r in want), key=key)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    return ""


if __name__ == "__main__":
    import tempfile
    import time

    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tmp).config("spark.local.dir", tmp).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for n in sys.argv[2:] or sorted(o):
        t = time.time()
        try:
            said = compare(spark, sys.argv[1], n, q[n], o[n]) if n in o else f"rows only: {q[n](spark, sys.argv[1]).count()}"
        except Exception as x:
            said = f"{type(x).__name__} {str(x)[:300]}"
        bad += bool(said)
        if said:
            print(n, round(time.time() - t, 1), said, flush=True)
    print(len(sys.argv[2:] or o), "queries,", bad, "remarks")
