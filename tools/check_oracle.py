"""Run registered queries against their check SQL: check_oracle.py SF_DIR [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from basketspark.catalog import QUERY_MODULE, all_oracles, all_queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = normal(got), normal(want)
    for c in got.columns:
        kinds = got[c].dtype.kind, want[c].dtype.kind
        a, b = got[c], want[c]
        if kinds[0] != kinds[1]:
            return f"column {c}: type {a.dtype} != {b.dtype}"
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"column {c}: {int(bad.sum())} of {len(a)} differ, first {a[i]!r} != {b[i]!r}"
    return ""


def main() -> None:
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    oracles = all_oracles()
    failed = 0
    for name, fn in all_queries().items():
        if wanted and not any(name.startswith(w) or w == QUERY_MODULE[name] for w in wanted):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: {str(e).strip()[:700]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name}: {len(got)} ({t1 - t0:.1f}s)", flush=True)
            continue
        try:
            want = con.execute(oracles[name]).df()
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name} sql: {str(e).strip()[:700]}", flush=True)
            continue
        msg = compare(got, want)
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name}: {len(got)} rows ({t1 - t0:.1f}s, sql {time.time() - t1:.1f}s) {msg}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
