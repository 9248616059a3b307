"""Run registered queries against their DuckDB counterparts and report differences.

    python -m checks.compare [--dir /root/testdata/sf0.001] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(map(_plain, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same columns and rows, in any order."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(rows(got), rows(want), strict=True):
        if a != b:
            return f"{str(a)[:300]} against {str(b)[:300]}"
    return None


def main() -> None:
    from checks.queries import ORACLES, QUERIES

    args = argparse.ArgumentParser()
    args.add_argument("--dir", default="/root/testdata/sf0.001")
    args.add_argument("names", nargs="*")
    args = args.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(str(Path(args.dir)))
    for name in args.names or QUERIES:
        t = time.time()
        try:
            got = QUERIES[name](spark, args.dir).toPandas()
            spent = time.time() - t
            if name in ORACLES:
                t = time.time()
                want = con.execute(ORACLES[name]).df()
                state = difference(got, want) or "ok"
                spent = f"{spent:.1f}s duckdb {time.time() - t:.1f}s"
            else:
                state, spent = "rows only", f"{spent:.1f}s"
            print(f"{name}: {state} ({len(got)} rows, {spent})", flush=True)
        except Exception as e:  # report and go on with the next query
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main()
