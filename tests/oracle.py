"""Compare a registered query with its SQL counterpart in DuckDB, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(value):
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, dt.datetime):
        return ("time", value.replace(tzinfo=None))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(kind(v) for v in value))
    return (type(value).__name__, value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(kind(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    mine = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    a, b = rows_of(spark_df.columns, mine), rows_of(names, theirs)
    if a == b:
        return None if a else "both empty"
    return (f"{len(mine)} rows against {len(theirs)}; only Spark {list((a - b).items())[:3]}; "
            f"only SQL {list((b - a).items())[:3]}")
