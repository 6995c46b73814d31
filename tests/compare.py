"""Compare the registered queries with their DuckDB SQL: python tests/compare.py [sf_dir] [name...]"""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    norm = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(norm, r)) for r in frame.itertuples(index=False)), key=str)


def differs(spark, name, f, sql, sf_dir) -> str:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got, want = f(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    return "" if a == b else f"{len(a)} and {len(b)} rows, first difference {next(((x, y) for x, y in zip(a, b) if x != y), None)}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for k, s in e.oracle_sql().items():
        if len(sys.argv) < 3 or k in sys.argv[2:]:
            try:
                print(k, differs(spark, k, e.queries()[k], s, sf)[:400] or "equal")
            except Exception as x:
                print(k, "FAILED", str(x)[:300])
    for k in e.queries().keys() - e.oracle_sql().keys():
        if not k.startswith("op") and k != "pipeline" and len(sys.argv) < 3:
            print(k, e.queries()[k](spark, sf).count(), "rows")
