"""Runs a registered query and its SQL twin and compares names, row counts and values."""

from __future__ import annotations

import datetime
import os
from decimal import Decimal

import duckdb

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(path: str):
    con = duckdb.connect()
    for name in VIEWS:
        file = os.path.join(path, f"{name}.parquet")
        if os.path.exists(file):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, Decimal)):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return repr([_plain(v) for v in value])
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    theirs = [c[0] for c in result.description]
    expected = normal(theirs, result.fetchall())
    if sorted(df.columns) != sorted(theirs):
        return f"columns {sorted(df.columns)} vs {sorted(theirs)}"
    actual = normal(df.columns, df.collect())
    if len(actual) != len(expected):
        return f"rows {len(actual)} vs {len(expected)}"
    for mine, other in zip(actual, expected):
        if mine != other:
            return f"{sorted(theirs)}: {mine} vs {other}"
    return None
