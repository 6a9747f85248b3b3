"""Runs queries and their SQL side by side. python -m tests.compare [sf] [name...]"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(tuple(v) if isinstance(v, list) else bytes(v) if isinstance(v, (bytearray, bytes)) else v for v in (r[i] for i in order)) for r in data]
    return [names[i] for i in order], sorted(out, key=repr)


def same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = rows([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p)) for p, q in zip(x, y))]
    exact = sum(x != y for x, y in zip(a[1], b[1]))
    return f"differ {len(bad)} of {len(a[1])}: {bad[0]}" if bad else ("" if not exact else f"near {exact}")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    con, qs, sql = duck(sf), e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or [q for q in qs if not q.startswith("op") and q != "pipeline"]:
        t = time.time()
        try:
            said = same(spark, con, qs[n], sql[n], sf) if n in sql else f"no SQL, {qs[n](spark, sf).count()} rows"
        except Exception as x:
            said = "ERROR " + " ".join(str(x).split())[:420]
        print(f"{n}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
