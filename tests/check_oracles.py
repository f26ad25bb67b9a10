"""Compare every query with its SQL: ``python tests/check_oracles.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return ""
    if isinstance(v, (bool, np.bool_)):
        return "true" if v else "false"
    if isinstance(v, (int, np.integer)):
        return repr(float(v))
    if isinstance(v, (float, np.floating)):
        return "" if math.isnan(v) else repr(float(f"{v:.9g}"))
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    expected = rows_of(names, result.fetchall())
    got_names = df.columns
    got = rows_of(got_names, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(got_names):
        return False, f"columns {sorted(got_names)} vs {sorted(names)}"
    groups = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{n}: {t} vs {kinds[n]}" for n, t in df.dtypes if t in groups and groups[t] != kinds[n]]
    note = f" types {odd}" if odd else ""
    if len(got) != len(expected):
        return False, f"{len(got)} rows vs {len(expected)}{note}; got {[g for g in got if g not in set(expected)][:2]}; want {[e for e in expected if e not in set(got)][:2]}"
    if got != expected:
        bad = [(g, e) for g, e in zip(got, expected) if g != e]
        return False, f"{len(bad)} of {len(got)} rows differ{note}: {str(bad[0])[:900]}"
    return True, f"{len(got)} rows{note}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            ok, note = compare(df, con, sql[name]) if name in sql else (True, f"{len(df.collect())} rows, no oracle")
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
