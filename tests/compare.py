"""Compare registered queries with DuckDB: ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


def difference(spark_df, relation) -> str | None:
    """None when both sides hold the same rows, else a short description."""
    got = spark_df.collect()
    cols_s, rows_s = rows_of(spark_df.columns, got)
    cols_d, rows_d = rows_of(relation.columns, relation.fetchall())
    if cols_s != cols_d:
        return f"columns differ: {set(cols_s) ^ set(cols_d)}"
    if len(rows_s) != len(rows_d):
        return f"row count {len(rows_s)} != {len(rows_d)}"
    bad = [(a, b) for a, b in zip(rows_s, rows_d) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(cols_s, a, b) if x != y]
        return f"{len(bad)}/{len(rows_s)} rows differ, first: {cells[:4]}"
    kinds = [(c, type(a), type(b)) for c, a, b in zip(cols_s, *(r[0] for r in (rows_s, rows_d)))] if rows_s else []
    odd = [k for k in kinds if k[1] is not k[2] and type(None) not in k[1:]]
    return f"types differ: {odd}" if odd else None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if len(args) > 1 and name not in args[1:]:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                diff = difference(df, con.sql(oracles[name]))
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                note = f"rows only: {len(df.collect())}"
        except Exception as e:
            note = f"ERROR {type(e).__name__}: {str(e).splitlines()[0][:400]}"
        failed += note.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
        spark.catalog.clearCache()
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
