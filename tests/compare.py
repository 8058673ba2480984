"""Compare a Spark result with the checking SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from glob import glob
from os.path import basename

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob(f"{sf_dir}/*.parquet"):
        name = basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when column names, row counts and values agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    found = _rows(spark_df.columns, spark_df.collect())
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    if found == expected:
        return []
    extra, missing = found - expected, expected - found
    return [f"rows {sum(found.values())} vs {sum(expected.values())}",
            f"only spark: {list(extra.items())[:3]}", f"only sql: {list(missing.items())[:3]}"]
