"""Run registered queries against their SQL in DuckDB: python tests/compare_sql.py [folder] [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for row in pdf.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
                out.append("")
            elif isinstance(v, (bool,)) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype"):
                out.append(repr(round(float(v), 9) + 0.0))
            elif hasattr(v, "strftime"):
                out.append(v.strftime("%Y-%m-%d"))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, folder: str, name: str, con) -> tuple[str, str]:
    got = entry.queries()[name](spark, folder).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("rows", f"{len(got)} rows")
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return ("FAIL", f"columns {sorted(got.columns)} vs {sorted(want.columns)}")
    a, b = canonical(got), canonical(want)
    if a == b:
        return ("ok", f"{len(a)} rows")
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return ("FAIL", f"{len(a)} vs {len(b)} rows; {sum(x != y for x, y in zip(a, b))} differ; {diff}")


if __name__ == "__main__":
    from portrisk.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    if os.environ.get("PLAIN_SESSION"):  # Spark's own defaults, as another driver may start it
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for n in names:
        t = time.time()
        try:
            status, note = compare(spark, folder, n, con)
        except Exception as e:  # report and go on
            status, note = "ERROR", f"{type(e).__name__}: {str(e)[:600]}"
        bad += status in ("FAIL", "ERROR")
        print(f"{status:5} {n:24} {time.time() - t:6.1f}s {note}", flush=True)
    print("bad:", bad)
