"""Run named queries next to their SQL texts and compare the rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


def make_spark() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("checks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    """Comparable text of a value; floats keep all digits."""
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0 if value else 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(x) for x in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(value.items())) + "}"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message) for one query."""
    started = time.time()
    frame = query(spark, sf_dir)
    rows = [tuple(row) for row in frame.collect()]
    spark_seconds = time.time() - started
    if sql is None:
        return True, f"rows-only {len(rows)} rows {spark_seconds:.2f}s"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    left_names, left = table(frame.columns, rows)
    right_names, right = table(names, other)
    if left_names != right_names:
        return False, f"columns {left_names} vs {right_names}"
    if len(left) != len(right):
        return False, f"row count {len(left)} vs {len(right)}"
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        first = [(n, x, y) for n, x, y in zip(left_names, *bad[0]) if x != y]
        return False, f"{len(bad)} of {len(left)} rows differ, e.g. {first[:6]}"
    return True, f"{len(left)} rows {spark_seconds:.2f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    session, con = make_spark(), duck(f"{DATA}/{sf}")
    session.sparkContext.setLogLevel("ERROR")
    texts, failed = entry.oracle_sql(), 0
    for key, fn in entry.queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(session, con, key, fn, texts.get(key), f"{DATA}/{sf}")
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print("ok  " if ok else "FAIL", key, message, flush=True)
    print("failed:", failed)
