"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = rows(spark_pdf), rows(duck_pdf)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return f"value differs at sorted row {i}: {x} vs {y}"
    return "ok"


def main() -> int:
    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from basketlab.session import build_session
    spark = build_session("local[8]", 8)
    qs, sql = queries(), oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"{name:32s} rows-only {len(sp)} rows  spark {t1 - t0:.1f}s")
            continue
        try:
            dk = con.execute(sql[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        res = compare(sp, dk)
        bad += res != "ok"
        print(f"{name:32s} {res[:400]}  ({len(sp)} rows, spark {t1 - t0:.1f}s, duck {time.time() - t1:.1f}s)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
