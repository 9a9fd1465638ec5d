"""Runs a query in Spark and its SQL in DuckDB over the same files and compares names, types and rows without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connection(d: str):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(d).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def compare(spark, query, sql: str, d: str, c=None) -> list[str]:
    """What differs; nothing if all is equal."""
    df = query(spark, d)
    names = sorted(df.columns)
    kinds = dict(df.dtypes)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = (c or connection(d)).execute(sql)
    columns = [x[0] for x in rel.description]
    types = {x[0]: str(x[1]) for x in rel.description}
    out = []
    if sorted(columns) != names:
        return [f"columns {names} and {sorted(columns)}"]
    out += [f"type of {n}: {kinds[n]} and {types[n]}" for n in names if KINDS.get(kinds[n], kinds[n]) != types[n]]
    at = [columns.index(n) for n in names]
    want = Counter(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        out.append(f"{sum(got.values())} and {sum(want.values())} rows; only in Spark {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}")
    return out
