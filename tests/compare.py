"""Compare a Spark result with a DuckDB result, ignoring row order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "orders", "lineitem")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(mode.fromString("formatted"))


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return (type(value).__name__, value)


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(spark_df, con, sql: str) -> int:
    got_rows = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    assert sorted(spark_df.columns) == sorted(want_columns)
    got, want = bag(spark_df.columns, got_rows), bag(want_columns, want_rows)
    missing, extra = want - got, got - want
    assert not missing and not extra, (
        f"{sum(missing.values())} missing, {sum(extra.values())} extra of {len(want_rows)}\n"
        f"columns {sorted(want_columns)}\n"
        f"missing {list(missing)[:3]}\nextra {list(extra)[:3]}"
    )
    return len(got_rows)
