"""Compare a Spark result with DuckDB's, as unordered sets of typed rows."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime):
        return "T" + value.isoformat()
    if isinstance(value, date):
        return "D" + value.isoformat()
    if isinstance(value, bool):
        return f"B{value}"
    return value


def difference(frame, connection, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    names = sorted(frame.columns)
    got = Counter(tuple(plain(row[n]) for n in names) for row in frame.collect())
    result = connection.execute(sql)
    wanted_names = [d[0] for d in result.description]
    if sorted(wanted_names) != names:
        return f"columns {names} instead of {sorted(wanted_names)}"
    order = [wanted_names.index(n) for n in names]
    want = Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    if got == want:
        return None
    return (
        f"{sum(got.values())} rows instead of {sum(want.values())}; "
        f"extra {[str(r)[:400] for r in list((got - want))[:2]]}; "
        f"missing {[str(r)[:400] for r in list((want - got))[:2]]}"
    )
