"""Comparison of a Spark result with the DuckDB result of the counterpart SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from tablewright.plans.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime.combine(value, datetime.time()).isoformat()
    return value


FAMILY = {
    "HUGEINT": "int", "BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "UBIGINT": "int",
    "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "text", "JSON": "text", "BOOLEAN": "bool",
    "TIMESTAMP": "time", "DATE": "date", "int": "int", "bigint": "int", "double": "float", "float": "float",
    "string": "text", "boolean": "bool", "timestamp_ntz": "time", "date": "date",
}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    order = sorted(df.columns)
    result = con.sql(sql)
    if order != sorted(result.columns):
        return f"columns {order} != {sorted(result.columns)}"
    kinds = {c: str(k) for c, k in zip(result.columns, result.types)}
    mine = dict(df.dtypes)
    for c in order:
        if FAMILY.get(mine[c], mine[c]) != FAMILY.get(kinds[c], kinds[c]):
            return f"type of {c}: {mine[c]} != {kinds[c]}"
    at = [result.columns.index(c) for c in order]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}; only spark {sorted(set(got) - set(want))[:2]}; only sql {sorted(set(want) - set(got))[:2]}"
    if want != got:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"values differ: {[(g[:700], w[:700]) for g, w in bad]}"
    return "no rows" if not want else None
