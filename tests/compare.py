"""Compare a Spark result with DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

from graticule.plans.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value) + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    return value


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def rows_of_duck(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short report."""
    left_names, left = rows_of_spark(df)
    right_names, right = rows_of_duck(con, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if left == right:
        return None
    key = repr
    only_left = sorted((left - right).elements(), key=key)[:3]
    only_right = sorted((right - left).elements(), key=key)[:3]
    return (f"{left_names}: {sum(left.values())} vs {sum(right.values())} rows; "
            f"only spark {only_left}; only sql {only_right}")
