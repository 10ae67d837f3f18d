"""Runs a query on Spark and its SQL on DuckDB and compares rows, columns and values exactly."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (datetime.date, bool, str)):
        return str(value)
    if isinstance(value, (int, decimal.Decimal, float)):
        return float(value)
    return str(value)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda t: tuple((v is None, str(v)) for v in t)
    )


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return normal(names, result.fetchall())


def difference(df, con, sql):
    """None when equal, otherwise what differs first."""
    left_names, left = spark_rows(df)
    right_names, right = duck_rows(con, sql)
    if left_names != right_names:
        return f"columns {left_names} / {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return str([(n, x, y) for n, x, y in zip(left_names, a, b) if x != y])
    return None


def main(sf="0.01", *wanted):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from clickgrain.session import build_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                said = difference(df, con, oracles[name]) or "equal"
            else:
                said = f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:1500]}"
        if not said.startswith(("equal", "rows only")):
            bad.append(name)
        print(f"{time.time() - start:6.2f}s {name}: {said[:1500]}", flush=True)
    print("not equal:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
