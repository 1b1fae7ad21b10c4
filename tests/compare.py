"""Runs the catalogue against its SQL in DuckDB on one data folder: python tests/compare.py [folder] [names...]"""

import math
import sys
import time
from collections import Counter
from datetime import datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, run, sql):
    """A message, or nothing if the rows agree."""
    df = run(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    at = [columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, sys.path[0] + "/..")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con, bad = duck(folder), 0
    queries, sql = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sql:
        began = time.time()
        try:
            said = compare(spark, con, folder, queries[name], sql[name])
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said)
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)" if said else f"{name} ok {time.time() - began:.1f}", flush=True)
    print(len(sql), "compared,", bad, "differ; without SQL:", sorted(set(queries) - set(sql)))
